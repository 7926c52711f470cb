"""Ordered string aggregation: speech segments -> transcript and summary.

A transcript is one string per video, so the last step must see a whole
video.  To keep one very long video from being sorted and buffered by a
single task, segments are first joined in contiguous chunks of
``chunk_segments`` (many tasks, bounded groups), and only the chunk
strings -- ``1 / chunk_segments`` as many rows -- meet per video.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import text as X


def _ordered_join(order_col: str, text_col: str):
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return F.array_join(F.transform(pairs, lambda s: s["t"]), " ")


def transcript_build(segments: DataFrame, video_col: str = "video_id", seg_col: str = "seg",
                     text_col: str = "text", chunk_segments: int = 1024,
                     summary_chars: int = rules.SUMMARY_CHARS) -> DataFrame:
    """(video, transcript, summary): segment texts (invalid UTF-8 dropped)
    joined by one space in segment order, stripped; summary = first
    ``summary_chars`` characters.  NULL texts are left out; a video with no
    other text has an empty transcript."""
    seg = segments.select(video_col, seg_col, X.drop_invalid_utf8(F.col(text_col)).alias(text_col))
    chunks = (seg.withColumn("__chunk", F.floor(F.col(seg_col) / F.lit(chunk_segments)))
              .groupBy(video_col, "__chunk")
              .agg(F.when(F.count(text_col) > 0, _ordered_join(seg_col, text_col)).alias("__part")))
    whole = chunks.groupBy(video_col).agg(_ordered_join("__chunk", "__part").alias("__t"))
    t = X.strip_ws(F.col("__t"))
    return whole.select(video_col, t.alias("transcript"),
                        F.substr(t, F.lit(1), F.lit(summary_chars)).alias("summary"))
