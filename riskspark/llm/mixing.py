"""Mixing sources to target weights with DataFrame operations only.

Words per source are summed (partial sums per task, so one source holding
most rows is no hot key), targets follow from the weights and a ceiling on
repetition, and each document is emitted floor(rate) times plus one more
time with probability equal to the fraction, decided by a hash of its id
and the seed: the same decision on every run and every partitioning.  Rows
without an id or repeating one draw for themselves, by their text and their
place in the table too; reruns over the same files agree on them.

Defined cases: a null or empty text has size 0 and takes 0 words, whatever
its copies; a null source is a source of its own and comes last; a source
of size 0 has target 0 and keeps no copy; rows with equal or null ids decide
each for itself; an empty table gives an empty mix; further columns, also ones named
like the results, are kept under ``with_columns`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.plans.strategy import join_small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)      # by position of the source in code point order, repeating
SHARE = (3, 2)           # the mix holds 3/2 of all words
MAX_REPEAT = 2           # no source is repeated more often
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
            max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sharing by weight with a ceiling, the excess reshared until none is
    above, ends at one level x: a source gets min(ceiling, weight * x).
    Sources ordered by ceiling / weight reach their ceilings in that order,
    so running sums give x.  The two windows below run over one row per
    source, not over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("source_size").over(everything) * share[0] / F.lit(share[1])
            - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weights_left)
    reached = F.col("level") * F.col("weight") < F.col("cap")
    # the level is that of the first source, in this order, that stays below its ceiling
    level = F.min(F.when(reached, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    below = level.isNotNull() & (F.col("weight") * level["level"] < F.col("cap"))
    return per.select("source", "source_size",
                      F.when(below, F.col("weight") * level["level"]).otherwise(F.col("cap").cast("double"))
                      .alias("target"))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the key and the seed (48 bits of MD5)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def repeated_ids(docs: DataFrame, doc_id: str) -> DataFrame:
    """(again): the ids that several rows have.  Only the id column is read;
    rows are counted before the shuffle, so a hot id is one row per task."""
    ids = docs.select(F.col(doc_id).alias("again")).where("again IS NOT NULL")
    return ids.groupBy("again").count().where("count > 1").select("again")


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
         with_columns: bool = False, seed: str = SEED, **how) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies (and, with
    ``with_columns``, the row itself as struct ``row``)."""
    size = n_words(F.col(text))
    cols = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")]
    place = F.concat_ws("|", F.xxhash64(F.col(text)), F.monotonically_increasing_id()).alias("place")
    rows = docs.select(*cols, place, *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_columns else []))
    rows = rows.withColumn("again", F.col("doc_id"))
    rows = join_small(rows, repeated_ids(docs, doc_id).withColumn("several", F.lit(True)), "again", "left")
    alone = F.col("doc_id").isNotNull() & F.col("several").isNull()
    key = F.when(alone, F.col("doc_id").cast("string")).otherwise(
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("place")))
    # Not to read whole texts twice, sizes alone are summed; one row per source is joined back.
    per = targets(docs.select(*cols[1:]), **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    one_more = chance(key, seed) < rate - F.floor(rate)
    per = per.withColumnRenamed("source", "mix_source")
    return (rows.join(per, F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn("copies", F.floor(rate) + one_more.cast("long"))
            .drop("mix_source", "source", "again", "several", "place"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan says, with its own columns."""
    out = plan(docs, with_columns=True, **how).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
