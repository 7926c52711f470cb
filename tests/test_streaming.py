"""The scoring job runs unchanged on a stream (file source -> Parquet sink)."""

import os
import tempfile

from riskspark.operators.scoring import score_posts
from riskspark.sources import fixtures as FX
from riskspark.streaming.scoring_stream import score_stream
from tests.conftest import SF001


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="riskspark-stream-")
    src, sink, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    posts = FX.posts(spark, SF001)
    posts.write.parquet(src)
    q = score_stream(spark, src, sink, FX.fixture_rf_probability("post_id"), checkpoint=ck)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink).select("post_id", "mm_risk", "mm_risk_level", "risk_score_v2")
    batch = score_posts(posts, FX.fixture_rf_probability("post_id")).select(
        "post_id", "mm_risk", "mm_risk_level", "risk_score_v2")
    assert sorted(streamed.collect()) == sorted(batch.collect())
