"""Comment aggregation (FIXTURES.md 2.8) and its plan."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators import comments as CM


def _videos(spark, rows):
    return spark.createDataFrame(rows, "tag string, video_url string, status string")


def _comments(spark, rows):
    return spark.createDataFrame(rows, "video_url string, pos long, text string")


def test_comment_risk_golden(spark):
    v = _videos(spark, [("a", "v1", "ok"), ("a", "v2", "ok"), ("b", "v3", "ok"), ("b", "v4", "failed")])
    # three distinct lexicon words outweigh the neutral prior of 2
    words = {"NEG": "sad alone hopeless", "NEU": "fine", "POS": "happy great amazing"}
    c1 = [("v1", i, f"{words[l]} {i}") for i, l in enumerate(["NEG", "NEU", "POS", "POS"])]
    c2 = [("v2", i, f"sad alone hopeless {i}") for i in range(8)] + [("v2", 100 + i, f"fine {i}") for i in range(12)]
    c4 = [("v4", 0, "sad")]
    out = {r.video_url: r for r in CM.comment_risk(v, _comments(spark, c1 + c2 + c4)).collect()}
    assert set(out) == {"v1", "v2", "v3"}  # unreachable video vanishes
    assert (out["v1"].risk_score, out["v1"].risk_level, out["v1"].n_comments) == (0.375, "LOW", 4)
    assert (out["v1"].neg_count, out["v1"].neu_count, out["v1"].pos_count) == (1, 1, 2)
    assert (out["v2"].risk_score, out["v2"].risk_level) == (pytest.approx(0.7), "HIGH")
    assert (out["v3"].n_comments, out["v3"].risk_score, out["v3"].risk_level) == (0, 0.2, "LOW")


def test_strip_then_distinct_then_cap(spark):
    rows = [("v", 0, "a"), ("v", 1, "a "), ("v", 2, "b"), ("v", 3, "  ")]
    got = CM.comment_topn(_comments(spark, rows)).orderBy("rank").collect()
    assert [(r.text, r.pos, r.rank) for r in got] == [("a", 0, 1), ("b", 2, 2)]
    many = [("w", i, f"c{i:02d}") for i in range(25)]
    top = CM.comment_topn(_comments(spark, many)).collect()
    assert sorted(r.text for r in top) == [f"c{i:02d}" for i in range(20)]


def test_limit_runs_before_the_shuffle_and_the_model(spark):
    rows = [("v", i, f"t{i}") for i in range(50)]
    top = CM.comment_topn(_comments(spark, rows))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 20


def test_hot_video_gives_same_result_when_repartitioned(spark):
    rows = [("hot", i, f"x{i % 40}") for i in range(400)] + [("cold", 0, "y")]
    c = _comments(spark, rows)
    a = sorted(CM.comment_topn(c).collect())
    b = sorted(CM.comment_topn(c.repartition(13)).collect())
    assert a == b and len(a) == 21
    _ = F


def test_transcript_of_a_hot_video_is_whole_and_ordered(spark):
    from riskspark.operators.transcripts import transcript_build

    rows = [(1, i, f"w{i}") for i in range(3000)] + [(2, 0, " x "), (2, 1, "y")]
    seg = spark.createDataFrame(rows, "video_id long, seg long, text string").repartition(7)
    got = {r.video_id: r for r in transcript_build(seg, chunk_segments=256).collect()}
    want = " ".join(f"w{i}" for i in range(3000))
    assert got[1].transcript == want and got[1].summary == want[:300]
    assert got[2].transcript == "x  y"  # " x " + " " + "y", stripped
