"""Golden rows for the Column helpers (FIXTURES.md 2.1, 2.4, 2.9; traps)."""

import math

import pytest
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import text as X

PARSE = [
    ("", 0), (None, 0), ("987", 987), ("1,234", 1234), ("12,345,678", 12345678), ("1.2K", 1200),
    ("1,5k", 1500), (" 3M ", 3000000), ("4.35K", 4350), ("1.001K", 1000), ("1.9999K", 1999),
    ("2.3456789M", 2345678), ("0.0005K", 0), ("1,234.5K", 0), ("1.234.567", 0), ("1.5", 0),
    ("2B", 0), ("K", 0), ("abc", 0), ("-5", -5), ("+7", 7), ("infK", 0), ("1e3", 0), ("1e2K", 100000),
    ("1_000", 0),  # Python's int() accepts the underscore; documented difference
]


def test_parse_count(spark):
    df = spark.createDataFrame([(s,) for s, _ in PARSE], "s string")
    got = [r[0] for r in df.select(X.parse_count("s")).collect()]
    assert got == [v for _, v in PARSE]


KW = [
    ("Kill Myself", 1, 1), ("depression depression", 1, 1), ("standalone skyscraper", 2, 2),
    ("self harm / self-harm", 2, 2), ("help me, i give up", 0, 2), ("can’t do this", 0, 0),
    ("", 0, 0), (None, 0, 0),
]


def test_keyword_hits(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in KW], "t string")
    got = df.select(X.keyword_hits("t", rules.KEYWORDS_V1).alias("a"),
                    X.keyword_hits("t", rules.KEYWORDS_V2).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in KW]


def test_clean_text_unicode(spark):
    df = spark.createDataFrame([("See http://x.y/z @Ali #Sad  NOW",), ("@ışıkçı merhaba",),
                                (None,), ("a  b\n",)], "t string")
    got = [r[0] for r in df.select(X.clean_text("t")).collect()]
    assert got == ["see now", "merhaba", "", "a b"]


def test_strip_is_python_strip(spark):
    vals = ["  a b \t", " x ", "\n\n", "y"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    assert [r[0] for r in df.select(X.strip_ws("t")).collect()] == [v.strip() for v in vals]


def test_clean_caption_reference_is_strip(spark):
    v = "  look http://a.b/c   twice  "
    df = spark.createDataFrame([(v,)], "t string")
    r = df.select(X.clean_caption("t").alias("a"), X.clean_caption("t", "documented").alias("b")).first()
    assert r.a == v.strip()
    assert r.b == "look twice"


def test_to_bool(spark):
    vals = [("True", True), (" yes ", True), ("1", True), ("0", False), ("no", False), ("FALSE", False)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "t string")
    assert [r[0] for r in df.select(X.to_bool("t")).collect()] == [b for _, b in vals]
    num = spark.createDataFrame([(0.0,), (2.0,), (float("nan"),)], "x double")
    from pyspark.sql import types as T
    assert [r[0] for r in num.select(X.to_bool("x", T.DoubleType())).collect()] == [False, True, True]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.5,), (-1.0,), (0.3,)], "x double")
    assert [r[0] for r in df.select(N.clamp01("x")).collect()] == [None, 1.0, 0.0, 0.3]


def test_round_half_away_scales_binary_value(spark):
    df = spark.createDataFrame([(1.005,), (0.0625,), (2.5,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(N.round_half_away("x", 2).alias("a")).collect()]
    assert got[0] == 1.0 and got[2] == 2.5
    got3 = [r[0] for r in df.select(N.round_half_away("x", 3)).collect()]
    assert got3[1] == 0.063


def test_levels_and_percent_label(spark):
    df = spark.createDataFrame([(0.7000000000000001,), (0.4,), (0.39999,), (None,)], "x double")
    assert [r[0] for r in df.select(N.risk_level("x")).collect()] == ["HIGH", "MEDIUM", "LOW", None]
    p = spark.createDataFrame([(70.0,), (40.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in p.select(N.percent_label("x")).collect()] == ["HIGH", "MEDIUM", "LOW", "LOW"]


def test_softmax_and_argmax_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.5, 0.5, 0.1)], "a double, b double, c double")
    r = df.select(N.softmax3("a", "b", "c").alias("p")).collect()
    e = [math.exp(x - 3.0) for x in (1.0, 2.0, 3.0)]
    assert r[0].p == pytest.approx([x / sum(e) for x in e])
    lab = df.select(N.argmax3_label("a", "b", "c")).collect()
    assert [x[0] for x in lab] == ["POS", "NEG"]  # tie goes to the first


def test_keyword_expression_is_compact(spark):
    # many fused rules must stay within one generated method (no fallback)
    df = spark.range(3).select(F.lit("kill myself help me").alias("t"))
    assert df.select(X.keyword_hits("t", rules.KEYWORDS_V2)).first()[0] == 2


def test_drop_invalid_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xffc"),), (bytearray("ok �".encode()),), (None,)], "b binary")
    got = [r.t for r in df.select(X.drop_invalid_utf8(F.col("b").cast("string")).alias("t")).collect()]
    assert got == ["abc", "ok �", None]
