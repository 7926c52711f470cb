"""Comment-based video risk.

Plan (two shuffles, both skew-tolerant):
  1. strip + drop blank, then distinct per (video, text) keeping the first
     position -- shuffled on (video, text), so one very busy video is still
     spread over many tasks, with map-side partial aggregation;
  2. first N per video by that position -- ``row_number() <= N``, which Spark
     turns into a partial ``WindowGroupLimit`` *before* the shuffle, so at
     most N rows per video and map partition cross the network;
  3. label with the sentiment scorer -- after the limit, so the (possibly
     Python) model never sees more than N comments per video;
  4. per-video counts and mean (partial aggregation), then a left join from
     the reached videos so videos without comments get the 0.2 / LOW row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import text as X
from riskspark.operators import sentiment as SE


def comment_topn(comments: DataFrame, video_col: str = "video_url", pos_col: str = "pos",
                 text_col: str = "text", n: int = rules.MAX_COMMENTS_PER_VIDEO) -> DataFrame:
    """First ``n`` distinct non-blank comments per video, in first-seen order.

    Output: video, pos (first position of the text), text (stripped), rank.
    """
    c = comments.select(
        F.col(video_col).alias(video_col), F.col(pos_col).alias(pos_col),
        X.strip_ws(F.col(text_col)).alias(text_col),
    ).filter(F.col(text_col).isNotNull() & (F.col(text_col) != F.lit("")))
    first = c.groupBy(video_col, text_col).agg(F.min(pos_col).alias(pos_col))
    w = Window.partitionBy(video_col).orderBy(F.col(pos_col), F.col(text_col))
    return (first.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.lit(n))
            .select(video_col, pos_col, text_col, F.col("rank").cast("bigint").alias("rank")))


def label_risk(label) -> "F.Column":
    lab = F.col(label) if isinstance(label, str) else label
    expr = None
    for name, val in rules.COMMENT_LABEL_RISK:
        expr = F.when(lab == F.lit(name), F.lit(val)) if expr is None else expr.when(lab == F.lit(name), F.lit(val))
    return expr.otherwise(F.lit(0.0))


def comment_risk(videos: DataFrame, comments: DataFrame, tag_col: str = "tag", video_col: str = "video_url",
                 status_col: str | None = "status", make_scorer: Callable | None = None,
                 n: int | None = None,
                 profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> DataFrame:
    """Per-video comment risk (tag, video_url, n_comments, neg/neu/pos counts,
    risk_score rounded to 3, risk_level from the unrounded mean).

    Videos whose page could not be reached (``status != 'ok'``) are left out;
    reached videos without comments get n=0, 0.2, LOW.
    """
    from riskspark.schemas import require_columns

    require_columns(videos, [tag_col, video_col])
    top = comment_topn(comments, video_col, "pos", "text", profile.max_comments if n is None else n)
    labelled = SE.score_sentiment(top, "text", make_scorer, profile=profile)
    lab = F.col("sentiment")
    agg = labelled.groupBy(video_col).agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.count_if(lab == "NEG").alias("neg_count"),
        F.count_if(lab == "NEU").alias("neu_count"),
        F.count_if(lab == "POS").alias("pos_count"),
        F.avg(label_risk(lab)).alias("avg_risk"),
    )
    reached = videos
    if status_col and status_col in videos.columns:
        reached = videos.filter(F.col(status_col) == F.lit("ok"))
    reached = reached.select(F.col(tag_col).alias("tag"), F.col(video_col).alias(video_col))
    j = reached.join(agg, video_col, "left")
    zero = F.lit(0).cast("bigint")
    avg = F.coalesce(F.col("avg_risk"), F.lit(rules.COMMENT_EMPTY_RISK))
    return j.select(
        "tag", video_col,
        F.coalesce(F.col("n_comments"), zero).cast("bigint").alias("n_comments"),
        F.coalesce(F.col("neg_count"), zero).cast("bigint").alias("neg_count"),
        F.coalesce(F.col("neu_count"), zero).cast("bigint").alias("neu_count"),
        F.coalesce(F.col("pos_count"), zero).cast("bigint").alias("pos_count"),
        N.round_half_away(avg, 3).alias("risk_score"),
        N.risk_level(avg).alias("risk_level"),
    )
