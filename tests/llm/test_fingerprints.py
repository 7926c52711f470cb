"""Sketches answer as sets do, at a cost that grows with the digests."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riskspark.llm import fingerprints as B


def test_likeness_of_sketches(spark):
    rng = random.Random(4)
    some = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    rows = [([], []), ([], some(1)), (some(3), []), (some(1), some(1))]
    for n in (2, 5, 9, 30, 120, 700):
        both = some(n)
        rows += [(both, both), (both + some(n), both), (some(n), some(2 * n)), (both + some(3), some(n // 2) + both[::-1])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a array<long>, b array<long>")
    df = df.select("i", F.expr(B.sketched("a")).alias("x"), F.expr(B.sketched("b")).alias("y"))
    got = {r["i"]: r["near"] for r in df.select("i", F.expr(B.likeness("x", "y")).alias("near")).collect()}
    for i, (a, b) in enumerate(rows):
        a, b = set(a), set(b)
        assert got[i] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_many_digests(spark):
    """All pairs of 30,000 digests that are found at once would take minutes."""
    df = spark.range(1).selectExpr("transform(sequence(1, 30000), i -> xxhash64(i)) AS a", "transform(sequence(1, 30000), i -> xxhash64(i, 7)) AS b")
    df = df.select(F.expr(B.sketched("a")).alias("x"), F.expr(B.sketched("b")).alias("y"))
    began = time.time()
    assert df.select(F.expr(B.likeness("x", "y"))).first()[0] == 0.0
    assert time.time() - began < 60
