"""The corpus pipeline: toxic documents go, one document of each group of
near-duplicates stays, repeated passages are removed, sources are mixed to
their target weights, and the mix is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result
is written as Parquet and read again as the next stage's ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, jaccard, mixing, suffixdedup, toxicity
from riskspark.llm.queries import VOCABULARY, table
from riskspark.llm.staging import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut.  The classifier
    learns from the labelled documents of the whole table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, column="toxicity").where(F.col("toxicity") < toxicity.CUT).drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked documents: the one with the smallest
    id (null ids last, then by a hash of id and text).  A row is known by id
    and text, so rows without an id or repeating one are documents of their
    own.  Rows without words are linked with nothing and all stay."""
    stage = Stage(spark, "near")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), *COLUMNS)
    member = stage.write(jaccard.join(keyed, doc_id="key").where("n_shingles > 0")
                         .groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count("*").alias("n")), "member")
    ids = keyed.where("text IS NOT NULL").select("key", "doc_id").distinct()
    chosen = (member.join(ids, "key").groupBy("component_id")
              .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("one")).select("one.key"))
    others = stage.write(member.select("key").join(chosen, "key", "left_anti"), "others")
    left = keyed.join(others, "key", "left_anti")
    # of rows equal in id and text the least stays; without words they are no members
    equal = member.where("n > 1").select("key")
    one = left.join(equal, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(equal, "key", "left_anti").select(*COLUMNS).unionByName(one)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings that also start elsewhere are cut out of the
    texts; documents that lose all of their text by it go.  Those that had
    none and lost nothing stay."""
    out = suffixdedup.deduplicated(docs.select(*COLUMNS, F.octet_length("text").alias("n_bytes")))
    emptied = (F.octet_length("text") < F.col("n_bytes")) & (F.length(F.trim("text")) == 0)
    return (out.where(~F.coalesce(emptied, F.lit(False)))
            .withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mix."""
    import public_tokenizers as P

    return bpe.tokenize(docs, P.path(VOCABULARY), P.PATTERN, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None       # a trained classifier, a similarity join and an encoder are not SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), name)
        if k:
            stage.release(STAGES[k - 1][0])
    return docs
