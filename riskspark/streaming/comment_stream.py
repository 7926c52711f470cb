"""Comment risk on a stream of comments.

The state of a video is its first ``n`` distinct non-blank comments in page
order with their labels: at most ``n`` rows, whatever has been read.  A later
batch may bring a comment from further up the page, which pushes the last one
out; one pushed out can only come back from a place before it, so nothing
else has to be remembered.  A video's risk is emitted again after every batch
that changed it, and its last row equals the batch job's over all comments so
far, however they were split into batches.

The rows of a video reach its state as an iterator of Arrow batches, so a
video with a third of all comments is read piece by piece and holds ``n`` of
them; the size of a trigger bounds what one task reads.  Comments are labelled
when they enter the state, not again in later batches.

Defined cases: null and blank comments do not count; comments without a video
form a group of their own; a null position comes first; further columns are
not read.  A restarted query resumes from its checkpoint; a batch that is run
again overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import text as X
from riskspark.operators.sentiment import lexicon_scorer

STATE = "pos array<bigint>, text array<string>, label array<string>"
UPDATE = "video_url string, n_comments bigint, neg_count bigint, neu_count bigint, pos_count bigint, avg_risk double"


def _first(pos, text) -> tuple:
    return (pos is not None, pos or 0, text)


def _merge(kept: dict, frame: pd.DataFrame, n: int) -> dict:
    """``kept`` (text -> position) with the comments of ``frame``, cut to the first ``n``."""
    for pos, text in zip(frame["pos"].tolist(), frame["text"].tolist()):
        pos = None if pd.isna(pos) else int(pos)
        old = kept.get(text, pos)
        known = [p for p in (pos, old) if p is not None]
        kept[text] = min(known) if known else None
        if len(kept) > 4 * n + 64:
            kept = _cut(kept, n)
    return _cut(kept, n)


def _cut(kept: dict, n: int) -> dict:
    return dict(sorted(kept.items(), key=lambda e: _first(e[1], e[0]))[:n])


def comment_risk_updates(comments: DataFrame, video_col: str = "video_url", pos_col: str = "pos", text_col: str = "text",
                         make_scorer: Callable | None = None,
                         profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> DataFrame:
    """(video_url, n_comments, neg / neu / pos counts, risk_score, risk_level)
    of every video that a batch of the streaming ``comments`` changed."""
    n, factory = profile.max_comments, make_scorer or lexicon_scorer(profile)
    risk = dict(rules.COMMENT_LABEL_RISK)
    scorer = []                                             # made once a worker

    def labels(texts: list[str]) -> list[str]:
        if not texts:
            return []
        if not scorer:
            scorer.append(factory())
        best = np.asarray(scorer[0](np.array(texts, dtype=object))).reshape(len(texts), 3).argmax(axis=1)
        return [rules.SENTIMENT_LABELS[i] for i in best]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, known = {}, {}
        if state.exists:
            pos, text, label = state.get
            before, known = dict(zip(text, pos)), dict(zip(text, label))
        kept = dict(before)
        for frame in frames:
            kept = _merge(kept, frame, n)
        if state.exists and kept == before:
            return
        new = [t for t in kept if t not in known]
        known.update(zip(new, labels(new)))
        label = [known[t] for t in kept]
        state.update((list(kept.values()), list(kept), label))
        counts = [label.count(x) for x in rules.SENTIMENT_LABELS]
        yield pd.DataFrame([(key[0], len(label), *counts, sum(risk.get(x, 0.0) for x in label) / len(label))],
                           columns=["video_url", "n_comments", "neg_count", "neu_count", "pos_count", "avg_risk"])

    rows = comments.select(F.col(video_col).alias("video_url"), F.col(pos_col).cast("long").alias("pos"),
                           X.strip_ws(F.col(text_col)).alias("text")).where("text <> ''")
    out = rows.groupBy("video_url").applyInPandasWithState(update, UPDATE, STATE, "update", GroupStateTimeout.NoTimeout)
    return out.select("video_url", "n_comments", "neg_count", "neu_count", "pos_count",
                      N.round_half_away(F.col("avg_risk"), 3).alias("risk_score"), N.risk_level(F.col("avg_risk")).alias("risk_level"))


def start(updates: DataFrame, sink_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the updates of every batch to a folder of its own under ``sink_dir``.
    Both folders must be shared by all executors."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={number}")

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def latest(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The last row of every video.  A video has one row a batch at most, and
    the choice keeps one row per video and task before the shuffle."""
    w = Window.partitionBy("video_url").orderBy(F.col("batch").desc())
    rows = spark.read.option("basePath", sink_dir).parquet(sink_dir)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "batch")
