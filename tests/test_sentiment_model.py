"""The trained sentiment scorer: better than the lexicon on rows held out, stored and read back, equal to Spark's own predictions."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.operators import sentiment as SE
from riskspark.operators import sentiment_model as SM
from riskspark.plans.queries import registry
from riskspark.sources import fixtures as FX
from tests.conftest import SF01


def test_fitted_model_beats_the_lexicon(spark):
    got = registry()["sentiment_fitted"](spark, SF01).join(FX.sentiment_labels(spark, SF01), "doc_id").where("held_out")
    docs = FX.documents(spark, SF01).select("doc_id", "text")
    lexicon = SE.score_sentiment(docs, "text").select("doc_id", F.col("sentiment").alias("by_lexicon"))
    rows = got.join(lexicon, "doc_id").collect()
    right = np.mean([r["sentiment"] == r["label"] for r in rows])
    lexicon_right = np.mean([r["by_lexicon"] == r["label"] for r in rows])
    assert len(rows) > 50 and right > lexicon_right + 0.1, (right, lexicon_right)
    assert all(abs(r["neg"] + r["neu"] + r["pos"] - 1) < 1e-5 for r in rows)


def test_scorer_equals_spark_and_survives_storage(spark):
    rows = [("bad sad day, so bad", "NEG"), ("sad night", "NEG"), ("plain day", "NEU"), ("plain night", "NEU"), ("Good glad DAY", "POS"),
            ("glad good night", "POS"), (None, "POS"), ("unlabelled", None), ("odd label", "MAYBE"), ("", "NEU")] * 3
    df = spark.createDataFrame(rows, "text string, label string")
    model = SM.fit(df, reg=1e-2)
    fitted = SM.pipeline(reg=1e-2).fit(SM.training_rows(df))
    train = SM.training_rows(df)
    assert train.count() == 21
    texts = [t for t, lab in rows if t is not None and lab in rules.SENTIMENT_LABELS]
    want = sorted(tuple(np.round(r["probability"].toArray(), 6)) for r in fitted.transform(train).collect())
    got = sorted(map(tuple, np.round(model.make_scorer()()(np.array(texts)), 6)))
    assert np.allclose(got, want, atol=1e-5)
    path = os.path.join(tempfile.mkdtemp(prefix="riskspark-sentiment-"), "model")
    model.save(spark, path)
    again = SM.SentimentModel.load(spark, path)
    assert np.allclose(again.make_scorer()()(np.array(texts)), model.make_scorer()()(np.array(texts)))
    scored = SE.score_sentiment(df, "text", again.make_scorer()).where("text = 'bad sad day, so bad'").first()
    assert scored["sentiment"] == "NEG"


def test_a_class_without_rows(spark):
    df = spark.createDataFrame([("bad day", "NEG"), ("plain day", "NEU")] * 4, "text string, label string")
    p = SM.fit(df).make_scorer()()(np.array(["bad day", "never seen"]))
    assert p.shape == (2, 3) and (p[:, 2] < 1e-3).all() and p[0].argmax() == 0
