"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

The number of sign bits follows the number of vectors (buckets of other
vectors stay small) and the number of tables follows from the bits, so that
a pair at the threshold is found with probability ``RECALL`` at every size.
Buckets are cut into blocks; a task compares two blocks of one bucket by
matrix products and returns counts and a spanning star of the links, never
the pairs, so a bucket holding a third of all vectors is spread over tasks
and its links are not expanded.  A pair is counted in the first table in
which it meets.

Defined cases: vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, link with nothing; vectors
of different lengths never link; rows repeating an id count as one vector
(the smallest), each gets a result row; labels and other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.graph import components
from riskspark.llm.staging import Stage

THRESHOLD = 0.95
RECALL = 0.9995
BLOCK = 1024            # vectors compared with each other at once
PER_BUCKET = 64         # unrelated vectors that share a bucket, on average
SEED = 17


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = min(40, max(6, round(math.log2(max(n, 2) / PER_BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


@lru_cache(maxsize=4)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, tables * bits))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number of each vector in each table (rows x tables)."""
    signs = (x @ _planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric link matrix."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, root[None, :], n).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id",
                    embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    stage = Stage(spark, "embeddings")
    all_rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                              F.col(embedding).cast("array<double>").alias("v"))
    fit = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) \
        & F.exists("v", lambda x: x != 0)
    one = stage.write(all_rows.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
                      .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    bits, n_tables = tables_for(one.count(), threshold)

    key_schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()),
                               T.StructField("bucket", T.ArrayType(T.LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                sig = signatures(_matrix(part.column(1)), bits, n_tables)
                lists = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, n_tables, dtype=np.int32), sig.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["vec_id", "dim", "bucket"])

    keys = stage.write(one.select("vec_id", "v", "dim").mapInArrow(hashed, key_schema)
                       .select("vec_id", "dim", F.posexplode("bucket").alias("t", "bucket")), "keys")
    sizes = stage.write(keys.groupBy("dim", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    placed = (keys.join(sizes, ["dim", "t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
              .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("vec_id", "dim", "t", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    cell = ["dim", "t", "bucket", "i", "j"]
    work = (placed.join(one.select("vec_id", "v"), "vec_id").repartition(*cell).sortWithinPartitions(*cell)
            .select(*cell, "own", "vec_id", "v"))
    out_schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("n", T.LongType()),
                               T.StructField("root", T.LongType())])

    def compare(cell_rows: pa.Table) -> pa.RecordBatch | None:
        dim, t, _, i, j = (cell_rows.column(c)[0].as_py() for c in range(5))
        own = cell_rows.column(5).to_numpy()
        ids = cell_rows.column(6).to_numpy()
        order = np.argsort(ids, kind="stable")
        own, ids = own[order], ids[order]
        x = _matrix(cell_rows.column(7).combine_chunks())[order]
        unit = np.sqrt((x * x).sum(1))
        linked = (x @ x.T) >= threshold * np.outer(unit, unit)
        np.fill_diagonal(linked, False)
        if i != j:      # inside a block its own cell counts
            linked &= own[:, None] != own[None, :]
        if not linked.any():
            return None
        some = np.flatnonzero(linked.any(1))
        sig = signatures(x[some], bits, n_tables)[:, :t]
        linked = linked[np.ix_(some, some)]
        for s in range(t):      # met in an earlier table
            linked &= sig[:, s][:, None] != sig[:, s][None, :]
        n = linked.sum(1)
        hit = n > 0
        if not hit.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[some][hit]), pa.array(n[hit].astype(np.int64)),
                                           pa.array(ids[some][_roots(linked)][hit])], names=["vec_id", "n", "root"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            cols = [table.column(c).to_numpy() for c in range(5)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            edges = np.concatenate([[0], change]).astype(int)
            for a, z in zip(edges[:-1], edges[1:]):
                if z - a > 1 and (r := compare(table.slice(a, z - a))) is not None:
                    yield r
            rest = table.slice(int(edges[-1]))
        if rest is not None and rest.num_rows > 1 and (r := compare(rest)) is not None:
            yield r

    found = stage.write(work.mapInArrow(scan, out_schema), "links")
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), stage)
    n_links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    res = n_links.join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = all_rows.select("vec_id").join(res, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"))
    stage.release("keys", "sizes")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
