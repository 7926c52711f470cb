"""DuckDB SQL fragments that mirror the Spark Column helpers one to one.

Used only to build the oracle statements in ``plans/oracle.py``: each
function returns SQL text for the same computation as its namesake in
``riskspark.functions`` / ``riskspark.operators``.  Constants are written as
DOUBLE casts (bare ``0.1`` is DECIMAL in DuckDB) and regexes reuse the exact
pattern text of ``functions.patterns``; ``regexp_replace`` gets the 'g' flag
because DuckDB replaces only the first match by default.
"""

from __future__ import annotations

from riskspark import rules
from riskspark.functions import patterns as P


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def d(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {q(P.WS_CHARS)})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(P.WS + '+')}, ' ', 'g')")


def clean_text(x: str) -> str:
    s = f"lower(coalesce(CAST({x} AS VARCHAR), ''))"
    s = f"regexp_replace({s}, {q(P.URL)}, ' ', 'g')"
    s = f"regexp_replace({s}, {q(P.MENTION)}, ' ', 'g')"
    s = f"regexp_replace({s}, {q(P.HASHTAG)}, ' ', 'g')"
    return collapse(s)


def clean_caption_documented(x: str) -> str:
    s = f"regexp_replace({x}, {q(P.URL)}, '', 'g')"
    s = f"regexp_replace({s}, {q(P.EMOJI)}, '', 'g')"
    s = f"regexp_replace({s}, {q(P.HASHTAG)}, '', 'g')"
    s = f"regexp_replace({s}, {q(P.MENTION)}, '', 'g')"
    return collapse(s)


def kw_hits(x: str, keywords) -> str:
    lc = f"lower(coalesce({x}, ''))"
    return "(" + " + ".join(f"(CASE WHEN contains({lc}, {q(k)}) THEN 1 ELSE 0 END)" for k in keywords) + ")"


def tokens(x: str, pattern: str = P.TOKEN1) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(pattern)})"


def clamp(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({d(0.0)}, least({d(1.0)}, {x})) END)"


def level(x: str) -> str:
    return (f"(CASE WHEN ({x}) >= {d(rules.LEVEL_HIGH)} THEN 'HIGH' WHEN ({x}) >= {d(rules.LEVEL_MEDIUM)} "
            f"THEN 'MEDIUM' WHEN ({x}) IS NOT NULL THEN 'LOW' END)")


def argmax3(a: str, b: str, c: str, labels) -> str:
    return (f"(CASE WHEN ({a}) >= ({b}) AND ({a}) >= ({c}) THEN {q(labels[0])} "
            f"WHEN ({b}) >= ({c}) THEN {q(labels[1])} ELSE {q(labels[2])} END)")


def lexicon_counts(x: str) -> tuple[str, str]:
    toks = tokens(x)
    n = f"CAST(len(list_intersect({toks}, {lst(rules.LEXICON_NEGATIVE)})) AS DOUBLE)"
    p = f"CAST(len(list_intersect({toks}, {lst(rules.LEXICON_POSITIVE)})) AS DOUBLE)"
    return n, p


_FLOAT_BODY = "^" + P.WS + r"*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?" + P.WS + "*$"
_INT_BODY = "^" + P.WS + "*[+-]?[0-9]+" + P.WS + "*$"


def parse_count(x: str) -> str:
    s = f"upper({strip(f'CAST({x} AS VARCHAR)')})"
    body = f"replace(substr({s}, 1, length({s}) - 1), ',', '.')"
    plain = f"replace({s}, ',', '')"

    def scaled(mult: float) -> str:
        return (f"CASE WHEN regexp_matches({body}, {q(_FLOAT_BODY)}) THEN "
                f"TRY_CAST(trunc(TRY_CAST({strip(body)} AS DOUBLE) * {d(mult)}) AS BIGINT) END")

    parsed = (f"CASE WHEN ends_with({s}, 'K') THEN {scaled(1000.0)} "
              f"WHEN ends_with({s}, 'M') THEN {scaled(1000000.0)} "
              f"ELSE CASE WHEN regexp_matches({plain}, {q(_INT_BODY)}) THEN TRY_CAST({strip(plain)} AS BIGINT) END END")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN CAST(0 AS BIGINT) ELSE coalesce({parsed}, CAST(0 AS BIGINT)) END)"


def to_bool(x: str) -> str:
    return f"(lower({strip(f'CAST({x} AS VARCHAR)')}) IN ('true', '1', 'yes'))"


def tag_base(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    whens = " ".join(f"WHEN {t} = {q(tag)} THEN {d(v)}" for tag, v in rules.TAG_BASE_RISK)
    return f"(CASE {whens} ELSE {d(rules.TAG_BASE_DEFAULT)} END)"


def boost(h: str) -> str:
    b = rules.KEYWORD_BOOST
    return (f"(CASE WHEN ({h}) <= 0 THEN {d(b[0])} WHEN ({h}) = 1 THEN {d(b[1])} "
            f"WHEN ({h}) = 2 THEN {d(b[2])} ELSE {d(b[3])} END)")


def adjust(base: str, sent: str) -> str:
    return clamp(f"(CASE WHEN {sent} = 'NEG' THEN {base} + {d(rules.SENTIMENT_ADJUST_NEG)} "
                 f"WHEN {sent} = 'POS' THEN {base} + {d(rules.SENTIMENT_ADJUST_POS)} ELSE {base} END)")


def merged(cap: str, tr: str) -> str:
    return f"(coalesce({cap}, '') || ' ' || coalesce({tr}, ''))"


def text_risk(tag: str, sent: str, cap: str, tr: str) -> str:
    hits = kw_hits(merged(cap, tr), rules.KEYWORDS_V2)
    return clamp(f"{adjust(tag_base(tag), sent)} + {boost(hits)}")


def engagement(likes: str, comments: str) -> str:
    total = f"(({likes}) + ({comments}))"
    return f"(CASE WHEN {total} <= 0 THEN {d(0.0)} ELSE {clamp(f'CAST({total} AS DOUBLE) / {d(rules.ENGAGEMENT_SCALE)}')} END)"


def kw_risk_v1(x: str) -> str:
    h = kw_hits(x, rules.KEYWORDS_V1)
    return f"(CASE WHEN {h} = 0 THEN {d(0.0)} ELSE least({d(1.0)}, CAST({h} AS DOUBLE) / {d(3.0)}) END)"


def risk_percent(cap: str, neg: str, like: str, comment: str, tag: str) -> str:
    bonus = f"(CASE WHEN lower({tag}) IN ({', '.join(q(t) for t in rules.BONUS_TAGS)}) THEN {d(rules.BONUS_TAG_VALUE)} ELSE {d(0.0)} END)"
    raw = (f"{d(rules.PCT_W_NEG)} * ({neg}) + {d(rules.PCT_W_KEYWORD)} * {kw_risk_v1(cap)} + "
           f"{d(rules.PCT_W_ENGAGEMENT)} * {engagement(parse_count(like), parse_count(comment))} + {bonus}")
    return f"round({clamp(raw)} * {d(100.0)}, 2)"


def emotion_base(e: str) -> str:
    el = f"lower(coalesce({e}, ''))"
    return (f"(CASE WHEN {el} IN ({', '.join(q(x) for x in rules.EMOTION_HIGH)}) THEN {d(rules.EMOTION_HIGH_VALUE)} "
            f"WHEN {el} = 'neutral' THEN {d(rules.EMOTION_NEUTRAL_VALUE)} WHEN {el} = 'happy' THEN {d(rules.EMOTION_HAPPY_VALUE)} "
            f"ELSE {d(rules.EMOTION_OTHER_VALUE)} END)")


def face_risk(e: str, score: str, missing_as_max: bool = True) -> str:
    s = f"(CASE WHEN {score} > {d(rules.FACE_PERCENT_CUTOFF)} THEN {score} / {d(100.0)} ELSE {score} END)"
    s = clamp(s)
    if missing_as_max:
        s = f"coalesce({s}, {d(1.0)})"
    return clamp(f"{d(0.5)} * {emotion_base(e)} + {d(0.5)} * {s}")


def visual_risk(sad: str, angry: str, bright: str, motion: str, missing_as_max: bool = True) -> str:
    bn = clamp(f"{bright} / {d(rules.VISUAL_BRIGHT_SCALE)}")
    mn = clamp(f"{motion} / {d(rules.VISUAL_MOTION_SCALE)}")
    if missing_as_max:
        bn, mn = f"coalesce({bn}, {d(1.0)})", f"coalesce({mn}, {d(1.0)})"
    vr = (f"{d(rules.VISUAL_W_SAD)} * {sad} + {d(rules.VISUAL_W_ANGRY)} * {angry} + "
          f"{d(rules.VISUAL_W_DULL)} * ({d(1.0)} - {bn}) + {d(rules.VISUAL_W_MOTION)} * {mn}")
    out = clamp(vr)
    return f"coalesce({out}, {d(1.0)})" if missing_as_max else out


def video_risk(policy: str = "reference") -> str:
    ref = policy == "reference"
    face = f"(CASE WHEN face_detected IS NULL THEN {'TRUE' if ref else 'NULL'} ELSE {to_bool('face_detected')} END)"
    vr = (f"(CASE WHEN {face} THEN {face_risk('face_emotion', 'face_emotion_score', ref)} "
          f"ELSE {visual_risk('visual_sad', 'visual_angry', 'visual_brightness', 'visual_motion', ref)} END)")
    if ref:
        return vr
    return f"(CASE WHEN {face} IS NULL THEN {d(0.5)} ELSE coalesce({vr}, {d(0.5)}) END)"


def rf_score(ph: str, pl: str, pm: str) -> str:
    return (f"(coalesce({pl}, {d(0.0)}) * {d(rules.RF_W_LOW)} + coalesce({pm}, {d(0.0)}) * {d(rules.RF_W_MEDIUM)} + "
            f"coalesce({ph}, {d(0.0)}) * {d(rules.RF_W_HIGH)})")


def fuse(t: str, r: str, v: str) -> str:
    return clamp(f"{d(rules.FUSION_W_TEXT)} * {t} + {d(rules.FUSION_W_RF)} * {r} + {d(rules.FUSION_W_VIDEO)} * {v}")
