"""Post scoring on a stream.

Scoring is stateless and per row, so the batch function runs unchanged on a
streaming DataFrame: files arriving in a folder are scored and appended to
a Parquet sink.  The checkpoint location must be on the shared file system
(by default under ``spark.checkpoint.dir``) so a restarted query resumes
exactly where it stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskspark import rules
from riskspark.operators.scoring import score_posts
from riskspark.schemas import POSTS
from riskspark.session import ensure_checkpoint_dir


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, rf_probability: Column,
                 checkpoint: str | None = None, profile: rules.RiskProfile = rules.DEFAULT_PROFILE,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a query: Parquet posts (``schemas.POSTS``) in ``source_dir`` ->
    scored posts appended to ``sink_dir``."""
    reader = spark.readStream.schema(POSTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    posts = reader.parquet(source_dir)
    scored = score_posts(posts, rf_probability, profile)
    if checkpoint is None:
        # one folder for each pair of source and sink: a restart resumes, another stream does not meet it
        pair = hashlib.sha256(f"{source_dir}\n{sink_dir}".encode()).hexdigest()[:32]
        checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{pair}"
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(sink_dir)
