"""Oracle SQL, third part: n-grams, TF-IDF, vocabulary, OOV."""

from __future__ import annotations

from riskspark.functions import patterns as P
from riskspark.operators import features as FE
from riskspark.plans import oracle as O
from riskspark.plans import sqlfrag as Q

d, q = Q.d, Q.q


def _corpus_text() -> str:
    parts = ", ".join(f"nullif({Q.clean_text(c)}, '')" for c in ("caption", "transcript", "summary"))
    return Q.strip(f"concat_ws(' ', {parts})")


CORPUS = O.RAW_POSTS + f""",
corpus AS (SELECT post_id, {_corpus_text()} AS text FROM posts),
labelled AS (SELECT * FROM corpus WHERE post_id IN (SELECT doc_id FROM labels))"""


def _terms(src: str, kind: str, prefix: str) -> str:
    if kind == "word":
        return f"""
{prefix}_tok AS (SELECT post_id, regexp_extract_all(lower(coalesce(text, '')), {q(P.TOKEN2)}) AS t FROM {src}),
{prefix}_terms AS (
  SELECT post_id, unnest(t) AS term FROM {prefix}_tok
  UNION ALL
  SELECT post_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {prefix}_tok
),
{prefix}_counts AS (SELECT post_id, term, count(*) AS tf FROM {prefix}_terms GROUP BY post_id, term)"""
    return f"""
{prefix}_w AS (SELECT post_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), {q(P.WS + '+')})) AS w FROM {src}),
{prefix}_pw AS (SELECT post_id, ' ' || w || ' ' AS p, length(w) + 2 AS L FROM {prefix}_w WHERE w <> ''),
{prefix}_ng AS (SELECT post_id, p, L, unnest(range(3, least(5, L) + 1)) AS n FROM {prefix}_pw),
{prefix}_ni AS (SELECT post_id, p, n, unnest(range(1, L - n + 2)) AS i FROM {prefix}_ng),
{prefix}_counts AS (SELECT post_id, substr(p, i, n) AS term, count(*) AS tf FROM {prefix}_ni GROUP BY ALL)"""


def _vocab(prefix: str, src: str, spec: FE.TfidfSpec) -> str:
    n = f"(SELECT CAST(count(*) AS DOUBLE) FROM {src})"
    limit = f"ORDER BY total DESC, term LIMIT {spec.max_features}" if spec.max_features else ""
    return f"""
{prefix}_vocab AS (
  SELECT term, df, total, ln(({d(1.0)} + {n}) / ({d(1.0)} + CAST(df AS DOUBLE))) + {d(1.0)} AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS total FROM {prefix}_counts GROUP BY term
    HAVING count(*) >= {spec.min_df} AND CAST(count(*) AS DOUBLE) <= {d(float(spec.max_df))} * {n}
    {limit})
)"""


def _weights(prefix: str, spec: FE.TfidfSpec) -> str:
    tf = f"({d(1.0)} + ln(CAST(c.tf AS DOUBLE)))" if spec.sublinear else "CAST(c.tf AS DOUBLE)"
    return f"""
{prefix}_w0 AS (SELECT c.post_id, c.term, {tf} * v.idf AS w FROM {prefix}_counts c JOIN {prefix}_vocab v ON v.term = c.term),
{prefix}_weights AS (SELECT post_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS weight FROM {prefix}_w0)"""


def _summary(prefix: str) -> str:
    return (f"SELECT post_id, CAST(sum(tf) AS BIGINT) AS n_grams, count(*) AS n_distinct, min(term) AS min_term, "
            f"max(term) AS max_term FROM {prefix}_counts GROUP BY post_id")


# Single words of caption || ' ' || transcript, the 5,000 most frequent, plain
# counts, smooth idf + 1, L2 norm: written out, nothing taken from the Spark side.
TFIDF_WORD = "WITH " + O.RAW_POSTS + r""",
v1 AS (SELECT post_id, lower(coalesce(caption, '') || ' ' || coalesce(transcript, '')) AS text FROM posts),
v1_tok AS (SELECT post_id, unnest(regexp_extract_all(text, '""" + P.TOKEN2 + r"""')) AS term FROM v1),
v1_tf AS (SELECT post_id, term, count(*)::DOUBLE AS tf FROM v1_tok GROUP BY post_id, term),
v1_top AS (SELECT term, count(*) AS df, sum(tf) AS total FROM v1_tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
v1_idf AS (SELECT term, ln((1 + (SELECT count(*) FROM v1))::DOUBLE / (1 + df)::DOUBLE) + 1::DOUBLE AS idf FROM v1_top),
v1_w AS (SELECT post_id, term, tf * idf AS w FROM v1_tf JOIN v1_idf USING (term))
SELECT post_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY post_id)), 6) AS weight FROM v1_w"""


def feature_queries() -> dict[str, str]:
    w = "WITH " + CORPUS + "," + _terms("corpus", "word", "wd")
    c = "WITH " + CORPUS + "," + _terms("corpus", "char", "ch")
    union = ("WITH " + CORPUS + "," + _terms("corpus", "word", "wd") + "," + _terms("corpus", "char", "ch") + ","
             + _vocab("wd", "corpus", FE.V2_WORD) + "," + _vocab("ch", "corpus", FE.V2_CHAR) + ","
             + _weights("wd", FE.V2_WORD) + "," + _weights("ch", FE.V2_CHAR) + """,
u AS (SELECT post_id, 'word' AS space, term, weight FROM wd_weights
      UNION ALL SELECT post_id, 'char', term, weight FROM ch_weights)""")
    oov = ("WITH " + CORPUS + "," + _terms("labelled", "word", "tr") + "," + _vocab("tr", "labelled", FE.V2_WORD)
           + "," + _terms("corpus", "word", "al") + """,
known AS (SELECT post_id, count(*) AS nnz FROM al_counts WHERE term IN (SELECT term FROM tr_vocab) GROUP BY post_id),
per_doc AS (SELECT c.post_id, coalesce(k.nnz, 0) AS nnz FROM corpus c LEFT JOIN known k ON k.post_id = c.post_id)
SELECT count(*) AS n_docs, count_if(nnz = 0) AS n_zero_nnz, round(avg(nnz), 6) AS mean_nnz,
       (SELECT count(*) FROM (SELECT DISTINCT term FROM al_counts) a
        WHERE term NOT IN (SELECT term FROM tr_vocab)) AS n_unknown_terms
FROM per_doc""")
    return {
        "word_ngrams": w + "\n" + _summary("wd"),
        "char_ngrams": c + "\n" + _summary("ch"),
        "tfidf_vocab": w + "," + _vocab("wd", "corpus", FE.V2_WORD)
        + "\nSELECT term, df, total, round(idf, 9) AS idf FROM wd_vocab",
        "tfidf_word": TFIDF_WORD,
        "tfidf_union": union + "\nSELECT post_id, space, count(*) AS nnz, round(sum(weight), 6) AS weight_sum "
        "FROM u GROUP BY post_id, space",
        "tfidf_nnz": union + "\nSELECT c.post_id, CAST(coalesce(n.nnz, 0) AS BIGINT) AS nnz FROM corpus c "
        "LEFT JOIN (SELECT post_id, count(*) AS nnz FROM u GROUP BY post_id) n ON n.post_id = c.post_id",
        "oov_summary": oov,
    }
