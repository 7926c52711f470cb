"""Comments on a stream: any split into batches gives the batch result, also over a restart; the state is bounded."""

import os
import random
import tempfile

from riskspark.operators import comments as CM
from riskspark.operators import sentiment as SE
from riskspark.sources import fixtures as FX
from riskspark.streaming import comment_stream as CS
from tests.conftest import SF001

SCHEMA = "video_url string, pos long, text string"
COLS = ("video_url", "n_comments", "neg_count", "neu_count", "pos_count", "risk_score", "risk_level")


def batch_result(spark, rows):
    comments = spark.createDataFrame(rows, SCHEMA)
    videos = comments.where("text IS NOT NULL AND trim(text) <> ''").selectExpr("'t' AS tag", "video_url").distinct()
    return sorted(CM.comment_risk(videos, comments).select(*COLS).collect())


def streamed(spark, parts, restart=False):
    base = tempfile.mkdtemp(prefix="riskspark-comments-")
    src, sink, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    groups = [parts[:1], parts[1:]] if restart else [parts]
    for group in groups:
        for part in group:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        CS.start(CS.comment_risk_updates(stream), sink, ck).awaitTermination(240)
    return spark, sink


def test_any_split_and_a_restart_give_the_batch_result(spark):
    rows = [tuple(r) for r in FX.comments(spark, SF001).select("video_url", "pos", "text").collect()]
    rng = random.Random(5)
    rows = rng.sample(rows, min(300, len(rows)))
    words = ["sad and alone", "happy day", "hopeless", "a plain day", "good", "  ", None]
    rows += [("hot", rng.randrange(1000), rng.choice(words) if k % 4 == 0 else f"comment {k % 90} {words[k % 5]}") for k in range(600)]
    rows += [("hot", 5, " good "), ("blank", 1, "  "), ("hot", 0, "from further up")]
    want = batch_result(spark, rows)
    for k, restart in ((1, False), (4, True)):
        rng.shuffle(rows)
        _, sink = streamed(spark, [rows[i::k] for i in range(k)], restart)
        assert sorted(CS.latest(spark, sink).select(*COLS).collect()) == want


def test_merge_keeps_the_first_and_no_more():
    import pandas as pd

    rng = random.Random(1)
    rows = [(rng.randrange(500), f"t{rng.randrange(120)}") for _ in range(2000)] + [(None, "t1"), (None, "none")]
    first = {}
    for pos, text in rows:
        known = [p for p in (pos, first.get(text, pos)) if p is not None]
        first[text] = min(known) if known else None
    want = sorted(first.items(), key=lambda e: (e[1] is not None, e[1] or 0, e[0]))[:20]
    kept = {}
    for k in range(0, len(rows), 37):
        kept = CS._merge(kept, pd.DataFrame(rows[k:k + 37], columns=["pos", "text"]), 20)
        assert len(kept) <= 20
    assert list(kept.items()) == want


def test_lexicon_scorer_equals_the_columns(spark):
    import numpy as np

    docs = FX.documents(spark, SF001).select("text").where("text IS NOT NULL")
    rows = SE.score_sentiment(docs, "text").select("text", "neg", "neu", "pos").collect()
    got = SE.lexicon_scorer()()([r["text"] for r in rows])
    assert np.allclose(got, [r[1:] for r in rows])
