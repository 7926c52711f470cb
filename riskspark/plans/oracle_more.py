"""Oracle SQL, second part: comments, transcripts, pages, reports."""

from __future__ import annotations

from riskspark import rules
from riskspark.plans import oracle as O
from riskspark.plans import queries_more as QM
from riskspark.plans import sqlfrag as Q
from riskspark.sources import fixtures as FX
from riskspark.sources import pages as PG

d, q, lst = Q.d, Q.q, Q.lst
URL = f"'{FX.VIDEO_URL_PREFIX}' || CAST(conv_id AS VARCHAR)"

COMMENTS = f"""
cm AS (
  SELECT {URL} AS video_url, turn AS pos, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT {URL}, turn + 50, text || ' ' || chr(10) FROM conversations WHERE role = 'user' AND conv_id % 3 = 0
  UNION ALL
  SELECT {URL}, CAST(99 AS BIGINT), '   ' FROM conversations WHERE role = 'user' AND conv_id % 5 = 0 AND turn = 0
),
cm_st AS (SELECT video_url, pos, {Q.strip('text')} AS text FROM cm),
cm_first AS (SELECT video_url, text, min(pos) AS pos FROM cm_st WHERE text IS NOT NULL AND text <> '' GROUP BY video_url, text),
cm_top AS (
  SELECT * FROM (SELECT video_url, pos, text, row_number() OVER (PARTITION BY video_url ORDER BY pos, text) AS rank FROM cm_first)
  WHERE rank <= {rules.MAX_COMMENTS_PER_VIDEO}
)"""

_N, _P = Q.lexicon_counts("text")
_SENT = Q.argmax3(f"{_N} / ({_N} + {_P} + {d(2.0)})", f"{d(2.0)} / ({_N} + {_P} + {d(2.0)})",
                  f"{_P} / ({_N} + {_P} + {d(2.0)})", rules.SENTIMENT_LABELS)

COMMENT_RISK = COMMENTS + f""",
cm_lab AS (SELECT video_url, {_SENT} AS sentiment FROM cm_top),
cm_agg AS (
  SELECT video_url, count(*) AS n_comments, count_if(sentiment = 'NEG') AS neg_count,
         count_if(sentiment = 'NEU') AS neu_count, count_if(sentiment = 'POS') AS pos_count,
         avg(CASE sentiment WHEN 'NEG' THEN {d(1.0)} WHEN 'NEU' THEN {d(0.5)} ELSE {d(0.0)} END) AS avg_risk
  FROM cm_lab GROUP BY video_url
),
vids AS (
  SELECT {lst(FX.FIXTURE_HASHTAGS)}[doc_id % 6 + 1] AS tag, '{FX.VIDEO_URL_PREFIX}' || CAST(doc_id AS VARCHAR) AS video_url
  FROM documents WHERE doc_id % 11 <> 10
)"""

# Patterns of the SQL side, for the markup of the given pages.
_HREF = q(r"<a\s[^>]*?href=\"([^\"]*)\"")
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
_BASE_DIR = r"^([^?#]*/)"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _decode(x: str) -> str:
    for ent, ch in _ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _resolve(href: str, base: str) -> str:
    origin = f"regexp_extract({base}, {q(_ORIGIN)}, 1)"
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1)"
    base_dir = f"regexp_extract({base}, {q(_BASE_DIR)}, 1)"
    return (f"(CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
            f"WHEN starts_with({href}, '#') OR starts_with({href}, '?') THEN regexp_extract({base}, '^([^#]*)', 1) || {href} "
            f"ELSE {base_dir} || {href} END)")


def _links(src: str, keep: str = "") -> str:
    k = (keep + ", ") if keep else ""
    return f"""
lk_raw AS (
  SELECT page_id, url, {k}unnest(range(len(hs))) AS pos, unnest(hs) AS href
  FROM (SELECT page_id, url, {k}regexp_extract_all(html, {_HREF}, 1) AS hs FROM {src})
),
lk_dec AS (SELECT page_id, url, {k}pos, {_decode('href')} AS href FROM lk_raw),
links AS (
  SELECT page_id, {k}{_resolve('href', 'url')} AS link, min(pos) AS pos FROM lk_dec
  WHERE contains(href, {q(QM.FIXTURE_LINK_CONTAINS)}) GROUP BY ALL
)"""


def _element(html: str, sel) -> str:
    tag, attr, value = sel
    attribute = rf"[^>]*?\s{attr}\s*=\s*[\"']{value}[\"']" if attr else ""
    inner = f"regexp_extract({html}, {q(rf'(?s)<{tag}\b{attribute}[^>]*>(.*?)</{tag}\s*>')}, 1)"
    return _decode(f"regexp_replace({inner}, '<[^>]*>', '', 'g')")


def _meta(html: str, name: str) -> str:
    import re

    pat = r"<meta\s[^>]*?name=\"" + re.escape(name) + r"\"[^>]*?content=\"([^\"]*)\""
    return _decode(f"regexp_extract({html}, {q(pat)}, 1)")


def _nonblank(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({Q.strip(x)}, '')" for x in xs) + ", '')"


DASH = O.SCORED + """,
view AS (
  SELECT *, mm_risk AS mm_risk_score, mm_risk_level AS mm_level, risk_score_v2 AS text_risk_score,
         rf_risk_score AS rf_risk, video_risk AS video_risk_score FROM scored
),
fv AS (SELECT * FROM view WHERE hashtag IS NOT NULL)"""


_MISSING = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
            "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")


def _csv_column(name: str, kind: str) -> str:
    """Expected type of a column whose values are of a known kind."""
    blank = f"{name} IS NULL" + (f" OR {name} IN {_MISSING}" if kind == "string" else "")
    with_gaps = {"bigint": "double", "boolean": "string"}.get(kind, kind)
    return (f"SELECT '{name}' AS \"column\", CASE WHEN count(*) = 0 THEN 'string' WHEN n_missing = count(*) THEN 'double' "
            f"WHEN n_missing = 0 THEN '{kind}' ELSE '{with_gaps}' END AS kind, count(*) AS n_rows, n_missing "
            f"FROM t, (SELECT count(*) FILTER ({blank}) AS n_missing FROM t) GROUP BY n_missing")


CSV_TYPES = """WITH t AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.toxic = 1 AS toxic, l.quality / 2.0 AS half_quality, l.quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
""" + "\nUNION ALL ".join(_csv_column(c, k) for c, k in (
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ("toxic", "boolean"), ("half_quality", "double"), ("quality", "bigint")))


def with_dash(body: str) -> str:
    return "WITH " + DASH + "\n" + body


def more_queries() -> dict[str, str]:
    caps = [_element("html", s) for s in QM.FIXTURE_CAPTION_SELECTORS] + [_meta("html", "description")]
    tags = ", ".join(q(t) for t in QM.DASH_FILTER_TAGS)
    r6 = lambda x: f"round({x}, 6)"
    return {
        "comment_topn": "WITH " + COMMENTS + "\nSELECT video_url, pos, text, CAST(rank AS BIGINT) AS rank FROM cm_top",
        "comment_risk": "WITH " + COMMENT_RISK + f"""
SELECT v.tag, v.video_url, CAST(coalesce(a.n_comments, 0) AS BIGINT) AS n_comments,
       CAST(coalesce(a.neg_count, 0) AS BIGINT) AS neg_count, CAST(coalesce(a.neu_count, 0) AS BIGINT) AS neu_count,
       CAST(coalesce(a.pos_count, 0) AS BIGINT) AS pos_count,
       round(coalesce(a.avg_risk, {d(rules.COMMENT_EMPTY_RISK)}), 3) AS risk_score,
       {Q.level(f"coalesce(a.avg_risk, {d(rules.COMMENT_EMPTY_RISK)})")} AS risk_level
FROM vids v LEFT JOIN cm_agg a ON a.video_url = v.video_url""",
        "transcript_build": f"""
SELECT video_id, {Q.strip('t')} AS transcript, substr({Q.strip('t')}, 1, {rules.SUMMARY_CHARS}) AS summary
FROM (SELECT conv_id AS video_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations
      WHERE text IS NOT NULL GROUP BY conv_id)""",
        "page_links": "WITH " + _links("pages") + "\nSELECT page_id, pos, link FROM links",
        "hashtag_sample": "WITH tagged AS (SELECT page_id, url, html, nullif(regexp_extract(url, "
        + q(QM.FIXTURE_TAG_PATTERN) + ", 1), '') AS hashtag FROM pages),\ntg AS (SELECT * FROM tagged WHERE hashtag IS NOT NULL),"
        + _links("tg", "hashtag") + """,
first AS (
  SELECT * FROM (SELECT hashtag, link, page_id, pos,
                        row_number() OVER (PARTITION BY hashtag, link ORDER BY page_id, pos) AS r FROM links) WHERE r = 1
)
SELECT hashtag, CAST(rank AS BIGINT) AS rank, link, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY hashtag ORDER BY page_id, pos, link) AS rank FROM first)
WHERE rank <= """ + str(rules.VIDEOS_PER_HASHTAG),
        "page_fields": f"""
SELECT page_id, url, {_nonblank(*caps)} AS caption,
       {Q.strip(_element('html', PG.LIKE_SELECTOR))} AS like_raw,
       {Q.strip(_element('html', PG.COMMENT_SELECTOR))} AS comment_raw
FROM pages""",
        "dash_table": with_dash("SELECT hashtag, caption, transcript, text_risk_score, rf_risk, video_risk_score, "
                                "mm_risk_score, mm_level, video_url FROM fv"),
        "dash_filter": with_dash(f"SELECT post_id, hashtag, mm_risk_score, mm_level FROM view WHERE hashtag IN ({tags})"),
        "dash_search": with_dash(f"SELECT post_id, hashtag, mm_level FROM fv "
                                 f"WHERE coalesce(regexp_matches(transcript, {q(QM.DASH_SEARCH)}, 'i'), false)"),
        "dash_metrics": with_dash(
            f"SELECT {r6('avg(text_risk_score)')} AS avg_text_risk, {r6('avg(rf_risk)')} AS avg_rf_risk, "
            f"{r6('avg(video_risk_score)')} AS avg_video_risk, {r6('avg(mm_risk_score)')} AS avg_mm_risk, "
            "count(*) AS n_videos FROM fv"),
        "dash_levels": with_dash(
            f"SELECT mm_level, n, {r6('CAST(n AS DOUBLE) / sum(n) OVER ()')} AS share FROM "
            "(SELECT mm_level, count(*) AS n FROM fv GROUP BY mm_level)"),
        "dash_hashtag": with_dash(
            f"SELECT hashtag, mm_level, count(*) AS n, {r6('sum(mm_risk_score)')} AS sum_mm_risk, "
            f"{r6('avg(mm_risk_score)')} AS avg_mm_risk FROM fv GROUP BY hashtag, mm_level"),
        "dash_hashtags": with_dash("SELECT DISTINCT hashtag FROM view WHERE hashtag IS NOT NULL"),
        "dash_topk": with_dash(f"SELECT post_id, hashtag, mm_risk_score, mm_level FROM fv "
                               f"ORDER BY mm_risk_score DESC NULLS LAST, post_id LIMIT {QM.TOP_K}"),
        "dash_sorted": with_dash("SELECT post_id, row_number() OVER (ORDER BY text_risk_score DESC NULLS LAST, post_id) AS row_no FROM fv"),
        "dash_page": with_dash("SELECT * FROM (SELECT post_id, hashtag, caption, transcript, text_risk_score, rf_risk, "
                               "video_risk_score, mm_risk_score, mm_level, video_url, "
                               "row_number() OVER (ORDER BY caption ASC NULLS LAST, post_id) AS row_no FROM fv) "
                               "WHERE row_no BETWEEN 51 AND 75"),
        # DuckDB reads no page whose bytes are not valid UTF-8, so none of these fails
        "page_status": """SELECT nullif(split_part(split_part(url, '://', 2), '/', 1), '') AS host, count(*) AS n_pages,
       CAST(0 AS BIGINT) AS n_failed FROM pages GROUP BY 1""",
        "csv_types": CSV_TYPES,
        "posts_head": with_dash(f"SELECT post_id, hashtag, caption, mm_risk_score, mm_level FROM view "
                                f"ORDER BY post_id LIMIT {QM.HEAD_ROWS}"),
        "label_counts": O.with_scored("SELECT rf_risk_label AS label, count(*) AS n FROM scored GROUP BY rf_risk_label"),
        "score_describe": O.with_scored(
            f"SELECT count(rf_risk_score) AS count, {r6('avg(rf_risk_score)')} AS mean, "
            f"{r6('stddev_samp(rf_risk_score)')} AS std, {r6('min(rf_risk_score)')} AS min, "
            f"{r6('quantile_cont(rf_risk_score, 0.25)')} AS p25, {r6('quantile_cont(rf_risk_score, 0.5)')} AS p50, "
            f"{r6('quantile_cont(rf_risk_score, 0.75)')} AS p75, {r6('max(rf_risk_score)')} AS max FROM scored"),
    }
