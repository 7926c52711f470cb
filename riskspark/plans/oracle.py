"""Oracle SQL (DuckDB) for every SQL-expressible query in ``plans/queries.py``.

The driver tables are registered as views under their own names.  Derived
tables are CTEs written once here and shared by the statements; their
definitions mirror ``sources/fixtures.py`` line for line.
"""

from __future__ import annotations

from riskspark import rules
from riskspark.plans import sqlfrag as Q
from riskspark.sources import fixtures as FX

d, q, lst = Q.d, Q.q, Q.lst


def _count_text(k: str, n: str) -> str:
    s = lambda x: f"CAST({x} AS VARCHAR)"
    return (f"(CASE ({k}) % 8 WHEN 0 THEN NULL WHEN 1 THEN {s(n)} "
            f"WHEN 2 THEN {s(f'({k}) % 10')} || '.' || {s(f'({k}) % 7')} || 'K' "
            f"WHEN 3 THEN {s(f'({k}) % 10')} || ',' || {s(f'({k}) % 9')} || 'k' "
            f"WHEN 4 THEN {s(f'({k}) % 5')} || 'M' "
            f"WHEN 5 THEN '1,' || lpad({s(f'({k}) % 1000')}, 3, '0') "
            f"WHEN 6 THEN ' ' || {s(f'({n}) % 500')} || ' ' ELSE 'n/a' END)")


def _vis(expr: str) -> str:
    return f"(CASE WHEN has_video AND NOT face AND doc_id % 7 <> 3 THEN {expr} END)"


RAW_POSTS = f"""
raw_docs AS (
  SELECT doc_id, text, n_chars,
         split_part(text, chr(10), 1) AS first_line,
         {lst(FX.FIXTURE_SUFFIXES)}[doc_id % 26 + 1] AS kw,
         doc_id % 9 <> 8 AS has_video,
         doc_id % 5 IN (0, 2, 4) AS face
  FROM documents
),
raw_posts AS (
  SELECT doc_id AS post_id,
    {lst(FX.FIXTURE_HASHTAGS)}[doc_id % 6 + 1] AS hashtag,
    CASE WHEN doc_id % 17 = 16 THEN NULL ELSE
      (CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE '' END) || first_line ||
      (CASE WHEN kw = '' THEN '' ELSE ' ' || kw END) ||
      (CASE doc_id % 7 WHEN 0 THEN ' http://t.example/v/' || CAST(doc_id AS VARCHAR)
                       WHEN 1 THEN ' @user' || CAST(doc_id AS VARCHAR)
                       WHEN 2 THEN ' #tag' || CAST(doc_id AS VARCHAR) ELSE '' END)
    END AS caption_raw,
    {_count_text('doc_id', 'n_chars')} AS like_raw,
    {_count_text('doc_id + 3', 'n_chars % 1000')} AS comment_raw,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE nullif(substr(text, length(first_line) + 2), '') END AS transcript,
    '{FX.VIDEO_URL_PREFIX}' || CAST(doc_id AS VARCHAR) AS video_url,
    CASE WHEN has_video THEN {lst(FX.FIXTURE_FACE_FLAGS)}[doc_id % 5 + 1] END AS face_detected,
    CASE WHEN has_video AND face THEN {lst(FX.FIXTURE_EMOTIONS)}[doc_id % 8 + 1] END AS face_emotion,
    CASE WHEN NOT has_video THEN NULL
         WHEN face AND doc_id % 13 = 0 THEN NULL
         WHEN face AND doc_id % 3 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / {d(100.0)}
         WHEN face THEN CAST(doc_id % 101 AS DOUBLE)
         ELSE {d(0.0)} END AS face_emotion_score,
    {_vis(f"CAST((doc_id * 11) % 100 AS DOUBLE) / {d(100.0)}")} AS visual_happy,
    {_vis(f"CAST((doc_id * 7) % 100 AS DOUBLE) / {d(100.0)}")} AS visual_sad,
    {_vis(f"CAST((doc_id * 3) % 60 AS DOUBLE) / {d(100.0)}")} AS visual_angry,
    {_vis(f"CAST((doc_id * 13) % 100 AS DOUBLE) / {d(100.0)}")} AS visual_calm,
    {_vis("CAST((doc_id * 17) % 300 AS DOUBLE)")} AS visual_blur,
    {_vis("CAST((doc_id * 19) % 256 AS DOUBLE)")} AS visual_brightness,
    {_vis("CAST(doc_id % 30 AS DOUBLE)")} AS visual_motion
  FROM raw_docs
),
raw_lex AS (
  SELECT *, {Q.lexicon_counts('caption_raw')[0]} AS ln, {Q.lexicon_counts('caption_raw')[1]} AS lp
  FROM raw_posts
),
raw_sent AS (
  SELECT *, ln / (ln + lp + {d(rules.LEXICON_PRIOR)}) AS neg,
            {d(rules.LEXICON_PRIOR)} / (ln + lp + {d(rules.LEXICON_PRIOR)}) AS neu,
            lp / (ln + lp + {d(rules.LEXICON_PRIOR)}) AS pos
  FROM raw_lex
),
posts AS (
  SELECT post_id, hashtag, {Q.strip('caption_raw')} AS caption, like_raw, comment_raw,
    {Q.argmax3('neg', 'neu', 'pos', rules.SENTIMENT_WORDS)} AS sentiment, neg, neu, pos,
    {Q.risk_percent('caption_raw', 'neg', 'like_raw', 'comment_raw', 'hashtag')} AS risk_yuzdesi,
    transcript, substr(transcript, 1, {rules.SUMMARY_CHARS}) AS summary, video_url,
    face_detected, face_emotion, face_emotion_score, visual_happy, visual_sad, visual_angry,
    visual_calm, visual_blur, visual_brightness, visual_motion
  FROM raw_sent
)"""

POST_COLS = (
    "post_id, hashtag, caption, like_raw, comment_raw, sentiment, neg, neu, pos, risk_yuzdesi, "
    "transcript, summary, video_url, face_detected, face_emotion, face_emotion_score, visual_happy, "
    "visual_sad, visual_angry, visual_calm, visual_blur, visual_brightness, visual_motion"
)

_MERGED = Q.strip("coalesce(caption, '') || ' ' || coalesce(transcript, '')")

SCORED = RAW_POSTS + f""",
sc_lex AS (
  SELECT *, {Q.lexicon_counts(_MERGED)[0]} AS s_n, {Q.lexicon_counts(_MERGED)[1]} AS s_p,
         CAST(post_id % 5 AS DOUBLE) AS rf_a, CAST(post_id % 3 + 1 AS DOUBLE) AS rf_b,
         CAST(post_id % 4 AS DOUBLE) AS rf_c
  FROM posts
),
sc_sent AS (
  SELECT *, {Q.argmax3('s_n / (s_n + s_p + ' + d(2.0) + ')', d(2.0) + ' / (s_n + s_p + ' + d(2.0) + ')',
                       's_p / (s_n + s_p + ' + d(2.0) + ')', rules.SENTIMENT_LABELS)} AS sentiment_v2,
         rf_a / (rf_a + rf_b + rf_c) AS p_high, rf_b / (rf_a + rf_b + rf_c) AS p_low,
         rf_c / (rf_a + rf_b + rf_c) AS p_medium
  FROM sc_lex
),
sc_parts AS (
  SELECT *, {Q.text_risk('hashtag', 'sentiment_v2', 'caption', 'transcript')} AS t_risk,
         {Q.rf_score('p_high', 'p_low', 'p_medium')} AS rf_s,
         {Q.argmax3('p_high', 'p_low', 'p_medium', rules.LEVELS)} AS rf_l,
         {Q.video_risk('reference')} AS v_risk
  FROM sc_sent
),
sc_mm AS (SELECT *, {Q.fuse('t_risk', 'rf_s', 'v_risk')} AS mm FROM sc_parts),
scored AS (
  SELECT {POST_COLS}, sentiment_v2, t_risk AS risk_score_v2, round(t_risk, 3) AS risk_numeric,
         {Q.level('t_risk')} AS risk_level_v2, rf_l AS rf_risk_label, rf_s AS rf_risk_score,
         round(v_risk, 3) AS video_risk, round(mm, 3) AS mm_risk, {Q.level('mm')} AS mm_risk_level
  FROM sc_mm
)"""


def with_posts(body: str) -> str:
    return "WITH " + RAW_POSTS + "\n" + body


def with_scored(body: str) -> str:
    return "WITH " + SCORED + "\n" + body


def post_queries() -> dict[str, str]:
    lex_merged = Q.lexicon_counts(_MERGED)
    return {
        "posts_scan": with_posts(f"SELECT {POST_COLS} FROM posts"),
        "posts_union": with_posts(f"SELECT {POST_COLS} FROM posts"),
        "keyword_hits": with_posts(
            f"SELECT post_id, {Q.kw_hits('caption', rules.KEYWORDS_V1)} AS kw_hits_v1, "
            f"{Q.kw_hits(Q.merged('caption', 'transcript'), rules.KEYWORDS_V2)} AS kw_hits_v2 FROM posts"),
        "keyword_hits_join": with_posts(
            f"SELECT post_id, CAST({Q.kw_hits(Q.merged('caption', 'transcript'), rules.KEYWORDS_V2)} AS BIGINT) AS kw_hits FROM posts"),
        "passage_posts": (
            "SELECT k.keyword, count(d.doc_id) AS n_texts, min(d.doc_id) AS first_id "
            "FROM (SELECT DISTINCT lower(text) AS keyword FROM benchmark WHERE length(text) > 0) k "
            "LEFT JOIN documents d ON contains(lower(d.text), k.keyword) GROUP BY k.keyword"),
        "tag_base_risk": with_posts(f"SELECT post_id, hashtag, {Q.tag_base('hashtag')} AS base_risk FROM posts"),
        "text_risk": with_scored(
            "SELECT post_id, sentiment_v2, risk_score_v2 AS text_risk, risk_level_v2 AS risk_level FROM scored"),
        "percent_label": with_posts(
            "SELECT post_id, risk_yuzdesi, CASE WHEN risk_yuzdesi >= 70 THEN 'HIGH' WHEN risk_yuzdesi >= 40 "
            "THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM posts"),
        "parse_counts": with_posts(
            f"SELECT post_id, like_raw, comment_raw, {Q.parse_count('like_raw')} AS likes, "
            f"{Q.parse_count('comment_raw')} AS comments FROM posts"),
        "to_bool": with_posts(f"SELECT post_id, face_detected, {Q.to_bool('face_detected')} AS face_flag FROM posts"),
        "risk_percent": with_posts(
            f"SELECT post_id, {Q.kw_risk_v1('caption_raw')} AS kw_score, "
            f"{Q.engagement(Q.parse_count('like_raw'), Q.parse_count('comment_raw'))} AS engagement, "
            f"risk_yuzdesi FROM raw_sent JOIN (SELECT post_id AS pid, risk_yuzdesi FROM posts) p ON p.pid = raw_sent.post_id"),
        "risk_documented": with_posts(
            f"SELECT post_id, {d(rules.DOC_W_NEG)} * neg + {d(rules.DOC_W_NEU)} * neu + {d(rules.DOC_W_POS)} * pos + "
            f"{d(rules.DOC_W_HIT)} * CAST({Q.kw_hits('caption', rules.KEYWORDS_V2)} AS DOUBLE) AS risk_documented FROM posts"),
        "video_risk_face": with_posts(
            f"SELECT post_id, face_emotion, face_emotion_score, "
            f"{Q.face_risk('face_emotion', 'face_emotion_score')} AS face_risk FROM posts "
            f"WHERE face_detected IS NOT NULL AND {Q.to_bool('face_detected')}"),
        "video_risk_visual": with_posts(
            f"SELECT post_id, {Q.visual_risk('visual_sad', 'visual_angry', 'visual_brightness', 'visual_motion')} AS visual_risk "
            f"FROM posts WHERE face_detected IS NOT NULL AND NOT {Q.to_bool('face_detected')}"),
        "video_risk_policy": with_posts(
            f"SELECT post_id, round({Q.video_risk('reference')}, 3) AS video_risk_reference, "
            f"round({Q.video_risk('neutral')}, 3) AS video_risk_neutral FROM posts"),
        "multimodal": with_scored(
            "SELECT post_id, risk_score_v2 AS text_risk, rf_risk_score AS rf_risk, video_risk, mm_risk, mm_risk_level FROM scored"),
        "score_posts": with_scored("SELECT * FROM scored"),
        "sentiment_scores": with_posts(
            f"SELECT post_id, neg, neu, pos, {Q.argmax3('neg', 'neu', 'pos', rules.SENTIMENT_LABELS)} AS sentiment FROM ("
            f"SELECT post_id, {lex_merged[0]} / ({lex_merged[0]} + {lex_merged[1]} + {d(2.0)}) AS neg, "
            f"{d(2.0)} / ({lex_merged[0]} + {lex_merged[1]} + {d(2.0)}) AS neu, "
            f"{lex_merged[1]} / ({lex_merged[0]} + {lex_merged[1]} + {d(2.0)}) AS pos FROM posts)"),
        "clean_text": with_posts(
            f"SELECT post_id, {Q.clean_text('caption')} AS caption_clean, {Q.clean_text('transcript')} AS transcript_clean FROM posts"),
        "clean_caption": with_posts(
            f"SELECT post_id, {Q.strip('caption_raw')} AS caption_reference, "
            f"{Q.clean_caption_documented('caption_raw')} AS caption_documented FROM raw_posts"),
        "softmax3": (
            "SELECT event_id, round(p0, 6) AS p_neg, round(p1, 6) AS p_neu, round(p2, 6) AS p_pos, "
            f"{Q.argmax3('p0', 'p1', 'p2', rules.SENTIMENT_LABELS)} AS label FROM ("
            "SELECT event_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ("
            "SELECT event_id, exp(a - greatest(a, b, c)) AS e0, exp(b - greatest(a, b, c)) AS e1, exp(c - greatest(a, b, c)) AS e2 FROM ("
            f"SELECT event_id, value / {d(10.0)} AS a, CAST(user_id % 7 AS DOUBLE) / {d(3.0)} AS b, "
            f"CAST(event_id % 5 AS DOUBLE) * {d(0.5)} AS c FROM events)))"),
        "json_field": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(post_queries())
    from riskspark.plans import oracle_features, oracle_more, oracle_training

    out.update(oracle_more.more_queries())
    out.update(oracle_features.feature_queries())
    out.update(oracle_training.training_queries())
    return out
