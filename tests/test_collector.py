"""The collector job on hand-written pages, and its query on the given tables."""

from __future__ import annotations

import pandas as pd

from riskspark import schemas
from riskspark.operators.collector import collect
from tests.conftest import SF001

POST = ('<div data-e2e="browse-video-desc"><b>I feel</b> {0}</div><strong data-e2e="like-count"> 1.2K </strong>'
        '<strong data-e2e="comment-count">7</strong>')


def inputs(spark):
    page = "page_id long, url string, html string"
    links = "".join(f"<a href='/video/{k}'>x</a>" for k in (1, 2, 1, 9, 3, 4))
    tags = spark.createDataFrame([(100, "https://h.example/tag/anxiety", links),
                                  (101, "https://h.example/tag/suicide", "<a href='/video/3'>y</a>"),
                                  (102, None, links), (103, "https://h.example/about", links)], page)
    stored = spark.createDataFrame([(1, "https://h.example/video/1", POST.format("alone")),
                                    (2, "https://h.example/video/2", None),
                                    (3, "https://h.example/video/3", POST.format("fine")),
                                    (30, "https://h.example/video/3", POST.format("a later copy")),
                                    (4, "https://h.example/video/4", POST.format("beyond the limit"))], page)
    segments = spark.createDataFrame([(1, 1, "world"), (1, 0, "hello"), (4, 0, "unused")], "video_id long, seg long, text string")
    frames = spark.createDataFrame([(v, f, 2, 2, [10 * f] * 4) for v in (1, 3) for f in range(2)],
                                   "video_id long, frame long, width int, height int, gray array<int>")
    return tags, stored, segments, frames


def test_rows(spark):
    out = collect(*inputs(spark), limit=4)
    assert out.columns == schemas.POSTS.names
    got = {(r["hashtag"], r["post_id"]): r for r in out.collect()}
    # /video/9 is not stored, so it vanishes; /video/4 is the fifth link
    assert set(got) == {("anxiety", 1), ("anxiety", 2), ("anxiety", 3), ("suicide", 3)}
    one, two, three = got["anxiety", 1], got["anxiety", 2], got["suicide", 3]
    assert (one["caption"], one["like_raw"], one["comment_raw"]) == ("I feel alone", "1.2K", "7")
    assert (one["transcript"], one["summary"]) == ("hello world", "hello world")
    assert (one["face_detected"], one["face_emotion"], one["face_emotion_score"]) == ("False", None, 0.0)
    assert abs(one["visual_brightness"] - 10) < 1e-9 and abs(one["visual_motion"] - 10) < 1e-9
    assert (two["caption"], two["like_raw"], two["transcript"], two["summary"]) == ("", "", "", "")
    assert two["face_detected"] is None and two["visual_happy"] is None and two["face_emotion_score"] is None
    assert (three["caption"], three["video_url"]) == ("I feel fine", "https://h.example/video/3")


def test_faces_replace_atmosphere(spark):
    faces = spark.createDataFrame([(1, "sad", 0.75)], "video_id long, face_emotion string, face_emotion_score double")
    got = {r["post_id"]: r for r in collect(*inputs(spark), faces=faces).collect()}
    assert (got[1]["face_detected"], got[1]["face_emotion"], got[1]["face_emotion_score"]) == ("True", "sad", 0.75)
    assert got[1]["visual_happy"] is None and got[3]["face_detected"] == "False" and got[3]["visual_happy"] is not None


def test_query_against_its_parts(spark):
    import __spark_entry__ as E

    q = E.queries()
    got = q["collect_pipeline"](spark, SF001).toPandas()
    sample = q["hashtag_sample"](spark, SF001).toPandas()
    said = q["transcript_build"](spark, SF001).toPandas().set_index("video_id")["transcript"].to_dict()
    assert 0 < len(got) <= len(sample)
    assert set(zip(got.hashtag, got.video_url)) <= set(zip(sample.hashtag, sample.link))
    for r in got.itertuples():
        assert r.transcript == said.get(r.post_id, "")
        assert pd.isna(r.face_detected) == pd.isna(r.visual_blur)


def test_query_stores_every_page(spark):
    """Every sampled link of the given tables has its page, under whichever of the page's links it is."""
    import __spark_entry__ as E

    q = E.queries()
    got = q["collect_pipeline"](spark, SF001).toPandas()
    sample = q["hashtag_sample"](spark, SF001).toPandas()
    assert sorted(zip(got.hashtag, got.video_url)) == sorted(zip(sample.hashtag, sample.link))
