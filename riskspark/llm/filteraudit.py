"""Interaction audit of filters: what each removes in every order.

A document's failures are five bits, so a part (a source) is described by
how many documents have each of the 32 patterns.  From these follow the
removals of all 32 coalitions of filters; a step of an order removes what
its coalition gains over the one before.  A filter's share of all removals
is its Shapley value, the solution of least squares over the coalitions
with the Shapley kernel as weight, under the condition that the shares add
up to the removals of all filters.  The normal equations are solved in
rationals, so the sum over all orders is a whole number without rounding.

Spark measures the texts, finds identical ones and counts patterns; the
tables of one part are 32 rows, solved in the task that holds the part.

Defined cases: null texts are empty; an empty text fails A alone (and E if
repeated); a null part is the empty string, as is a part of that name;
rows with a null id fail E never, and rows repeating id and text fail it
only if a smaller id has the text; a missing or null label is not 1, and
of several labels of an id one with 1 is enough; an empty table has no
part and no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.staging import Stage

FILTERS = "ABCDE"
N = len(FILTERS)
ALL = (1 << N) - 1
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = r"[A-Z]+"
SYMBOL = r"[#$%&*|]"
TABLES = ("docs", "good", "toxic")
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> dict[str, Column]:
    """Columns whose sum of ``2 ** place`` is the pattern of A to D, over words ``w`` and ``whole`` text."""
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(F.array_join(F.regexp_extract_all("whole", F.lit(CAPITALS), F.lit(0)), ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length("whole"),
            "D": F.col("whole").rlike(SYMBOL)}


def patterns(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             part: str = "source") -> DataFrame:
    """(part, pattern, docs, good, toxic): documents by part and failed filters."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("whole"))
    rows = rows.select("*", F.array_remove(F.split("whole", SPACE), "").alias("w"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("whole")).values())]
    # texts are read once; from here on a text is its digest
    digests = Stage(docs.sparkSession, "audit").write(
        rows.select("doc_id", "part", F.unhex(F.sha2("whole", 256)).alias("digest"),
                    sum(bits[1:], bits[0]).cast("int").alias("pattern")), "digests")
    # The first id of a text meets it under (text, id): copies of one text spread over all tasks.
    first = (digests.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    known = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (digests.join(first, ["digest", "doc_id"], "left")
            .select("doc_id", "part", (F.col("pattern") + F.when(copy, 1 << (N - 1)).otherwise(0)).alias("pattern"))
            .join(known, "doc_id", "left")
            .groupBy("part", "pattern").agg(F.count("*").alias("docs"), F.count_if(F.col("good")).alias("good"),
                                            F.count_if(F.col("toxic")).alias("toxic")))


def removals(counts: list[int]) -> list[int]:
    """Documents removed by each coalition of filters, from the counts of each pattern."""
    return [sum(c for p, c in enumerate(counts) if p & s) for s in range(ALL + 1)]


def _eliminate(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan on an augmented matrix; the right-hand columns of the result."""
    n = len(rows)
    for i in range(n):
        at = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


@lru_cache(maxsize=1)
def _solver() -> tuple[list[Fraction], list[list[Fraction]]]:
    """Kernel weights by coalition, and the inverse of the normal equations
    bordered by the condition that all shares add up."""
    kernel = [Fraction(0)] * (ALL + 1)
    for s in range(1, ALL):
        k = s.bit_count()
        kernel[s] = Fraction(N - 1, comb(N, k) * k * (N - k))
    rows = [[sum((kernel[s] for s in range(1, ALL) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(N)]
            + [Fraction(1)] for i in range(N)]
    rows.append([Fraction(1)] * N + [Fraction(0)])
    unit = [[Fraction(int(i == j)) for j in range(N + 1)] for i in range(N + 1)]
    return kernel, _eliminate([r + u for r, u in zip(rows, unit)])


def shapley(removed: list[int]) -> list[Fraction]:
    """Each filter's share of the removals: weighted least squares with the sum fixed."""
    kernel, inverse = _solver()
    right = [sum((kernel[s] * removed[s] for s in range(1, ALL) if s >> i & 1), Fraction(0)) for i in range(N)]
    right.append(Fraction(removed[ALL]))
    return [sum((a * b for a, b in zip(row, right)), Fraction(0)) for row in inverse[:N]]


def steps(part: str, counts: dict[str, list[int]]) -> Iterator[tuple]:
    """One row per order and step of a part."""
    total = sum(counts["docs"])
    gone, good, toxic = (removals(counts[t]) for t in TABLES)
    share = [x * factorial(N) for x in shapley(gone)]
    for order in permutations(range(N)):
        s = 0
        for step, f in enumerate(order, 1):
            after = s | 1 << f
            took = gone[after] - gone[s]
            yield (part, "".join(FILTERS[i] for i in order), step, total - gone[after], took, gone[1 << f] - took,
                   gone[ALL] - gone[ALL ^ 1 << f], good[after] - good[s], toxic[after] - toxic[s], int(share[f]))
            s = after


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    found = patterns(docs, labels, doc_id, text, part)
    entry = F.struct("pattern", *TABLES)
    per_part = found.groupBy("part").agg(F.collect_list(entry).alias("found"))      # at most 32 entries a part
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = {t: [0] * (ALL + 1) for t in TABLES}
                for e in row["found"]:
                    for t in TABLES:
                        counts[t][e["pattern"]] += e[t]
                cols = list(zip(*steps(row["part"], counts)))
                types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return per_part.mapInArrow(run, SCHEMA)
