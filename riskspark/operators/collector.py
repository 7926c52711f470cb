"""The collector job over stored tables: hashtag pages -> first N links per
hashtag -> the page behind each link -> its fields -> sentiment and percent
score -> transcript, summary and frame scores -> ``schemas.POSTS`` rows.

Defined cases: a link whose page is not stored vanishes; of several stored
pages of one URL the smallest page_id counts; a link found under two
hashtags gives a row for each; a video without segments has an empty
transcript and summary; one without frames and faces has NULL video columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import rules, schemas
from riskspark.operators.frames import frame_features
from riskspark.operators.scoring import collect_posts
from riskspark.operators.transcripts import transcript_build
from riskspark.sources import pages as PG

VISUAL = ("happy", "sad", "angry", "calm", "blur", "brightness", "motion")


def visited_fields(sample: DataFrame, stored: DataFrame, caption_selectors=PG.CAPTION_SELECTORS) -> DataFrame:
    """(hashtag, rank, video_url, post_id, caption_raw, like_raw, comment_raw)
    of every sampled link whose page is stored.  Only visited pages are
    parsed: the sample (N links per hashtag) meets the pages before that."""
    wanted = sample.select(F.col("link").alias("url")).distinct()
    visited = stored.select("page_id", "url", "html").join(wanted, "url", "left_semi")
    fields = PG.page_fields(visited, caption_selectors).groupBy("url").agg(
        F.min(F.struct("page_id", "caption", "like_raw", "comment_raw")).alias("p"))
    return sample.join(fields, sample["link"] == fields["url"]).select(
        "hashtag", "rank", F.col("link").alias("video_url"), F.col("p.page_id").alias("post_id"),
        F.col("p.caption").alias("caption_raw"), "p.like_raw", "p.comment_raw")


def video_columns(frames: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """(video_id, face_*, visual_*): a video in which a face was found carries
    the face's emotion and score, any other its atmosphere scores."""
    seen = frame_features(frames, places=None)
    if faces is None:
        v = seen.withColumns({"__emotion": F.lit(None).cast("string"), "__score": F.lit(None).cast("double"),
                              "__face": F.lit(False)})
    else:
        f = faces.select("video_id", F.col("face_emotion").alias("__emotion"),
                         F.col("face_emotion_score").cast("double").alias("__score"), F.lit(True).alias("__found"))
        v = seen.join(f, "video_id", "full").withColumn("__face", F.coalesce("__found", F.lit(False)))
    return v.select(
        "video_id", F.when(F.col("__face"), F.lit("True")).otherwise(F.lit("False")).alias("face_detected"),
        F.col("__emotion").alias("face_emotion"),
        F.when(F.col("__face"), F.col("__score")).otherwise(F.lit(0.0)).alias("face_emotion_score"),
        *[F.when(~F.col("__face"), F.col(c)).alias(f"visual_{c}") for c in VISUAL])


def collect(tag_pages: DataFrame, stored: DataFrame, segments: DataFrame, frames: DataFrame,
            faces: DataFrame | None = None, limit: int = rules.VIDEOS_PER_HASHTAG,
            contains: str = PG.VIDEO_LINK_CONTAINS, tag_pattern: str = PG.TAG_URL_PATTERN,
            caption_selectors=PG.CAPTION_SELECTORS, profile: rules.RiskProfile = rules.DEFAULT_PROFILE,
            make_scorer: Callable | None = None) -> DataFrame:
    """The posts table.  ``tag_pages`` and ``stored`` are (page_id, url, html);
    ``segments``, ``frames`` and ``faces`` name a video by the page_id of its
    stored page (``video_id``).  They are cut to the visited videos before
    they are assembled."""
    sample = PG.hashtag_sample(tag_pages, limit, contains, tag_pattern)
    raw = visited_fields(sample, stored, caption_selectors)
    videos = raw.select(F.col("post_id").alias("video_id")).distinct()
    spoken = transcript_build(segments.join(videos, "video_id", "left_semi"))
    shown = video_columns(frames.join(videos, "video_id", "left_semi"),
                          None if faces is None else faces.join(videos, "video_id", "left_semi"))
    raw = (raw.withColumn("video_id", F.col("post_id"))
           .join(spoken, "video_id", "left").join(shown, "video_id", "left")
           .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("transcript", "summary")}))
    return collect_posts(raw, profile, make_scorer).select(*schemas.POSTS.names)
