"""The registered queries of this subpackage and their SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns the query promises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import jaccard as J

    return J.join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import toxicity as X

    docs = table(spark, sf_dir, "documents")
    model = X.train(docs, table(spark, sf_dir, "labels"))
    return (X.score(docs.select("doc_id", "text"), model)
            .select("doc_id", X.held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= X.CUT).cast("int").alias("predicted")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import mixing as M

    return (M.plan(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), lev AS (
  SELECT *, (sum(source_size) OVER () * 3 / 2.0::DOUBLE
             - coalesce(sum(2 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS x
  FROM per
  WINDOW b AS (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT arg_min(x, 2 * source_size / w::DOUBLE) AS x FROM lev WHERE x * w < 2 * source_size
), t AS (
  SELECT lev.source, source_size,
         CASE WHEN cut.x IS NOT NULL AND w * cut.x < 2 * source_size THEN w * cut.x
              ELSE (2 * source_size)::DOUBLE END AS target FROM lev, cut
), r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import fingerprints as B

    return B.report(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from riskspark.llm import bpe

    return bpe.tokenize(table(spark, sf_dir, "documents"), P.path(VOCABULARY), P.PATTERN, with_ids=False, digests=True)


def op3_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import embeddings as V

    return V.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import langid as L

    docs = table(spark, sf_dir, "documents")
    return (L.identify(docs.select("doc_id", "text"), L.train(docs))
            .select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import pagetext as H

    return H.extract(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import licenses as S

    return S.scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import suffixdedup as D

    return D.removal_report(table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import hostrules as R

    return R.judge(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS met
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) v(k) WHERE met > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 100 * n_symbols > 10 * n_words AS f3,
         100 * n_dup_lines > 30 * n_lines AS f4,
         n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words) AS f5
  FROM m
), host AS (
  SELECT rule, source, count(*) AS n, count(*) FILTER (WHERE bad) AS bad
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS bad FROM f) GROUP BY rule, source
), sums AS (
  SELECT rule, count(*) AS k, sum(n)::DOUBLE AS docs, sum(n * n)::DOUBLE AS squares, sum(bad)::DOUBLE AS failed,
         sum(bad * bad / n::DOUBLE) AS parts
  FROM host GROUP BY rule
), ms AS (
  SELECT *, (parts - failed * failed / docs) / (k - 1) AS mb, (failed - parts) / (docs - k) AS mw, (docs - squares / docs) / (k - 1) AS size
  FROM sums WHERE k > 1 AND docs > k AND failed > 0 AND failed < docs
), prior AS (
  SELECT rule, round((mb - mw) / (mb + (size - 1) * mw), 6) AS rho FROM ms
), rate AS (
  SELECT source, round(CASE WHEN rho > 0 THEN (bad + failed / docs * (1 - rho) / rho) / (n + (1 - rho) / rho) ELSE failed / docs END, 6) AS r
  FROM host JOIN sums USING (rule) LEFT JOIN prior USING (rule)
), verdict AS (
  SELECT source, max(r) >= 0.5 AS host_rejected FROM rate GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT host_rejected AS kept,
       concat_ws(',', CASE WHEN f1 THEN 'short' END, CASE WHEN f2 THEN 'repeated' END, CASE WHEN f3 THEN 'symbols' END,
                 CASE WHEN f4 THEN 'lines' END, CASE WHEN f5 THEN 'word_length' END) AS failed_rules, host_rejected
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import filteraudit as A

    return A.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), mask AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(copy, false)::INT AS m, good, toxic
  FROM d LEFT JOIN lab USING (doc_id)
), pat AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM mask GROUP BY part, m
), letter AS (
  SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), step AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS s FROM orders)
), seen AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE m & (earlier | bit) = 0) AS kept,
         sum(n) FILTER (WHERE m & earlier = 0 AND m & bit > 0) AS removed,
         sum(n) FILTER (WHERE m & earlier > 0 AND m & bit > 0) AS redundant, sum(n) FILTER (WHERE m = bit) AS unique_fails,
         sum(good) FILTER (WHERE m & earlier = 0 AND m & bit > 0) AS good_lost,
         sum(toxic) FILTER (WHERE m & earlier = 0 AND m & bit > 0) AS toxic_lost
  FROM pat, step GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM seen
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import periodicruns as P

    return P.runs(table(spark, sf_dir, "documents"), edit=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dups": op3_embedding_dups,
    "op4_language": op4_language,
    "op5_source_mix": op5_source_mix,
    "op6_page_text": op6_page_text,
    "op7_licenses": op7_licenses,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_host_rules": op11_host_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op5_source_mix": OP5_SQL,
    "op11_host_rules": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
