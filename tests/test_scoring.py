"""Golden rows for the risk rules (FIXTURES.md 2.2, 2.3, 2.5, 2.6, 2.8)."""

import pytest
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.operators import scoring as SC
from riskspark.sources import fixtures as FX

TAGS = ["depression", "anxiety", "suicide", "psychosis", "other"]
# rows: tag -> sentiment -> [0 hits, 1, 2, >=3]
TABLE = {
    "depression": {"NEG": [.63, .78, .88, 1.0], "NEU": [.53, .68, .78, .93], "POS": [.48, .63, .73, .88]},
    "anxiety": {"NEG": [.53, .68, .78, .93], "NEU": [.43, .58, .68, .83], "POS": [.38, .53, .63, .78]},
    "suicide": {"NEG": [.83, .98, 1.0, 1.0], "NEU": [.73, .88, .98, 1.0], "POS": [.68, .83, .93, 1.0]},
    "psychosis": {"NEG": [.73, .88, .98, 1.0], "NEU": [.63, .78, .88, 1.0], "POS": [.58, .73, .83, .98]},
    "other": {"NEG": [.30, .45, .55, 0.7000000000000001], "NEU": [.20, .35, .45, .60], "POS": [.15, .30, 0.4, .55]},
}
TEXTS = ["", "alone", "alone hopeless", "alone hopeless kys"]


def _level(v):
    return "HIGH" if v >= .7 else "MEDIUM" if v >= .4 else "LOW"


def test_text_risk_sixty_cells(spark):
    data = [(t if t != "other" else None, s, TEXTS[h], None, TABLE[t][s][h], h)
            for t in TAGS for s in ("NEG", "NEU", "POS") for h in range(4)]
    df = spark.createDataFrame(data, "tag string, sent string, cap string, tr string, want double, h int")
    from riskspark.functions import numeric as N

    got = df.select("want", SC.text_risk("tag", "sent", "cap", "tr").alias("v")).withColumn(
        "lvl", N.risk_level("v")).collect()
    for r in got:
        assert r.v == pytest.approx(r.want, abs=1e-12)
        assert r.lvl == _level(r.want)
    # exact IEEE values that decide a level
    exact = {(r.want, r.v) for r in got}
    assert (0.7000000000000001, 0.7000000000000001) in exact
    assert (0.4, 0.4) in exact


def test_leading_space_tag_is_other(spark):
    df = spark.createDataFrame([(" Depression",)], "t string")
    assert df.select(SC.tag_base_risk("t")).first()[0] == 0.20


@pytest.mark.parametrize("neg,caption,likes,tag,want", [
    (0.0, "", "0", "anxiety", 0.0),
    (0.68, "alone", "1,234", "anxiety", 44.25),
    (0.5, "alone hopeless", "50K", "suicide", 70.0),
    (0.9, "alone hopeless kys", "110K", "selfharm", 100.0),
    (1.0, "alone hopeless kys suicide cutting", "10M", "self_harm", 100.0),
])
def test_risk_percent(spark, neg, caption, likes, tag, want):
    df = spark.createDataFrame([(neg, caption, likes, "0", tag)], "neg double, c string, l string, m string, t string")
    assert df.select(SC.risk_percent("c", "neg", "l", "m", "t")).first()[0] == pytest.approx(want)


FACE = [("sad", 85.0, .775), ("happy", 99.5, .5725), ("neutral", .6, .5), ("surprise", .2, .3),
        ("angry", 150.0, .85), ("disgust", -3.0, .35), ("sad", 1.5, .85), ("fear", 1.2, .85)]


def test_face_video_risk(spark):
    df = spark.createDataFrame(FACE, "e string, s double, want double")
    for r in df.select("want", SC.face_video_risk("e", "s").alias("v")).collect():
        assert r.v == pytest.approx(r.want)


VISUAL = [(0.5, 0.1, 0.0, 40.0, .55), (.2, .05, 255.0, 10.0, .1525), (0.0, 0.0, 300.0, -5.0, 0.0),
          (2.0, 2.0, 0.0, 20.0, 1.0), (0.0, 0.0, 128.0, 0.0, 0.0996078431372549)]


def test_visual_video_risk(spark):
    df = spark.createDataFrame(VISUAL, "s double, a double, b double, m double, want double")
    for r in df.select("want", SC.visual_video_risk("s", "a", "b", "m").alias("v")).collect():
        assert r.v == pytest.approx(r.want)


def test_missing_video_policies(spark):
    schema = "face_detected string, face_emotion string, face_emotion_score double, visual_sad double, " \
             "visual_angry double, visual_brightness double, visual_motion double"
    df = spark.createDataFrame([(None, None, None, None, None, None, None),
                                ("False", None, 0.0, None, None, None, None)], schema)
    ref = [r[0] for r in df.select(SC.video_risk(df)).collect()]
    neu = [r[0] for r in df.select(SC.video_risk(df, rules.RiskProfile(missing_video="neutral"))).collect()]
    assert ref == [pytest.approx(0.7), 1.0]
    assert neu == [0.5, 0.5]
    # no video columns at all -> the reproduced defaults
    bare = spark.createDataFrame([(1,)], "x int")
    assert bare.select(SC.video_risk(bare)).first()[0] == pytest.approx(0.0996078431372549)


@pytest.mark.parametrize("t,r,v,want", [(.63, .5, .7, .5985), (.2, .1, .0996, .14492), (.88, .8, .775, .831)])
def test_fusion(spark, t, r, v, want):
    df = spark.createDataFrame([(t, r, v)], "t double, r double, v double")
    assert df.select(SC.fuse("t", "r", "v")).first()[0] == pytest.approx(want)


def test_rf_score_and_label(spark):
    df = spark.createDataFrame([(.2, .5, .3)], "h double, l double, m double")
    r = df.select(SC.rf_score("h", "l", "m").alias("s"), SC.rf_label("h", "l", "m").alias("lab")).first()
    assert r.s == pytest.approx(.4) and r.lab == "LOW"


def test_level_from_unrounded_score(spark):
    from riskspark.functions import numeric as N

    df = spark.createDataFrame([(0.3996,)], "x double")
    r = df.select(N.round_half_away("x", 3).alias("s"), N.risk_level("x").alias("l")).first()
    assert r.s == 0.4 and r.l == "LOW"


def test_score_posts_has_no_shuffle(spark):
    from tests.conftest import SF001

    s = SC.score_posts(FX.posts(spark, SF001), FX.fixture_rf_probability("post_id"))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan
    out = s.select("risk_score_v2", "mm_risk", "video_risk", "rf_risk_score").collect()
    for r in out:
        for v in r:
            assert 0.0 <= v <= 1.0


def test_score_posts_invariant_under_repartition(spark):
    from tests.conftest import SF001

    p = FX.posts(spark, SF001)
    a = SC.score_posts(p, FX.fixture_rf_probability("post_id")).select("post_id", "mm_risk", "mm_risk_level")
    b = SC.score_posts(p.repartition(7), FX.fixture_rf_probability("post_id")).select(
        "post_id", "mm_risk", "mm_risk_level")
    assert sorted(a.collect()) == sorted(b.collect())


def test_batch_scorer_plugs_in(spark):
    from riskspark.operators import sentiment as SE

    def make():
        import numpy as np

        def fn(texts):
            out = np.zeros((len(texts), 3))
            for i, t in enumerate(texts):
                out[i] = [2.0, 0.0, 0.0] if "sad" in t else [0.0, 0.0, 2.0]
            return out
        return fn

    df = spark.createDataFrame([("so sad",), ("great day",), ("",)], "t string")
    got = SE.score_sentiment(df, "t", make_scorer=make, logits=True).select("sentiment", "neg", "neu", "pos").collect()
    assert [r.sentiment for r in got] == ["NEG", "POS", "NEU"]
    for r in got:
        assert r.neg + r.neu + r.pos == pytest.approx(1.0)
    assert (got[2].neg, got[2].neu, got[2].pos) == (0.0, 1.0, 0.0)


def test_lexicon_scorer(spark):
    from riskspark.operators import sentiment as SE

    df = spark.createDataFrame([("I feel sad and alone, sad",), ("",), ("happy happy",)], "t string")
    got = SE.score_sentiment(df, "t").collect()
    assert (got[0].neg, got[0].neu, got[0].pos) == pytest.approx((2 / 4, 2 / 4, 0.0))
    assert got[0].sentiment == "NEG"  # tie NEG = NEU goes to NEG
    assert (got[1].neg, got[1].neu, got[1].pos) == (0.0, 1.0, 0.0)
    assert got[2].sentiment == "NEU"  # one distinct positive word: neu 2/3 > pos 1/3
    _ = F


def test_bad_cells_and_large_counts_do_not_stop_the_job(spark):
    from pyspark.sql import functions as F

    from riskspark.operators import scoring as S

    df = spark.createDataFrame(
        [("sad", "n/a", "n/a", "0.1", "", "10", 2**63 - 1), ("sad", "85.0", "0.5", "0.1", "0", "40", 5)],
        "emotion string, score string, sad string, angry string, bright string, motion string, likes bigint")
    got = df.select(S.face_video_risk("emotion", "score").alias("face"),
                    S.visual_video_risk("sad", "angry", "bright", "motion").alias("visual"),
                    S.engagement_risk("likes", "likes").alias("eng")).collect()
    assert got[0]["face"] == 0.35 and abs(got[1]["face"] - 0.775) < 1e-12
    assert abs(got[0]["visual"] - (0.25 * 0.1 + 0.2 * (1 - 128 / 255) + 0.1 * 0.5)) < 1e-12
    assert abs(got[1]["visual"] - 0.55) < 1e-12
    assert got[0]["eng"] == 1.0


def test_describe_skips_nan(spark):
    from riskspark.operators.report import describe

    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    row = describe(df, "v").first()
    assert row["count"] == 2 and row["mean"] == 2.0 and row["max"] == 3.0
