"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each returns a lazy DataFrame over the driver tables (or tables Spark
derives from them); nothing is collected.  Column names match the oracle
statements in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import text as X
from riskspark.operators import scoring as SC
from riskspark.operators import sentiment as SE
from riskspark.sources import fixtures as FX
from riskspark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _posts(spark, sf_dir):
    return FX.posts(spark, sf_dir, spread=True)


def _raw_posts(spark, sf_dir):
    return FX.raw_posts(FX.documents(spark, sf_dir, spread=True))


def scored_posts(spark: SparkSession, sf_dir: str, profile=rules.DEFAULT_PROFILE) -> DataFrame:
    p = _posts(spark, sf_dir)
    return SC.score_posts(p, FX.fixture_rf_probability("post_id"), profile)


def q_posts_scan(spark, sf_dir):
    return _posts(spark, sf_dir)


def q_posts_union(spark, sf_dir):
    """Rows with and without a video carry different columns (a ragged
    union); missing columns come back as NULL."""
    p = _posts(spark, sf_dir)
    video_cols = [c for c in p.columns if c.startswith("face_") or c.startswith("visual_")]
    with_video = p.filter(F.col("face_detected").isNotNull())
    without = p.filter(F.col("face_detected").isNull()).drop(*video_cols)
    return with_video.unionByName(without, allowMissingColumns=True).select(*p.columns)


def q_keyword_hits(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select(
        "post_id",
        X.keyword_hits("caption", rules.KEYWORDS_V1).alias("kw_hits_v1"),
        X.keyword_hits(SC.merged_text("caption", "transcript"), rules.KEYWORDS_V2).alias("kw_hits_v2"),
    )


def q_keyword_hits_join(spark, sf_dir):
    from riskspark.operators.keywords import keyword_hits_join

    p = _posts(spark, sf_dir).select("post_id", SC.merged_text("caption", "transcript").alias("text"))
    dictionary = spark.createDataFrame([(k,) for k in rules.KEYWORDS_V2], "keyword string")
    return keyword_hits_join(p, dictionary, "post_id", "text")


def q_passage_posts(spark, sf_dir):
    """Benchmark passages, whole, as a dictionary of long entries: posts that hold each of them."""
    from riskspark.operators.keywords import keyword_posts
    from riskspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword_posts(docs, read_table(spark, sf_dir, "benchmark"), "doc_id", "text", keyword_col="text")


def q_tag_base_risk(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", "hashtag", SC.tag_base_risk("hashtag").alias("base_risk"))


def q_text_risk(spark, sf_dir):
    s = scored_posts(spark, sf_dir)
    return s.select("post_id", "sentiment_v2", F.col("risk_score_v2").alias("text_risk"),
                    F.col("risk_level_v2").alias("risk_level"))


def q_percent_label(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", "risk_yuzdesi", N.percent_label("risk_yuzdesi").alias("risk_label"))


def q_parse_counts(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", "like_raw", "comment_raw", X.parse_count("like_raw").alias("likes"),
                    X.parse_count("comment_raw").alias("comments"))


def q_to_bool(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", "face_detected", X.to_bool("face_detected").alias("face_flag"))


def q_risk_percent(spark, sf_dir):
    r = SE.score_sentiment(_raw_posts(spark, sf_dir), "caption_raw", labels=rules.SENTIMENT_WORDS)
    return r.select(
        "post_id",
        SC.keyword_risk_v1("caption_raw").alias("kw_score"),
        SC.engagement_risk(X.parse_count("like_raw"), X.parse_count("comment_raw")).alias("engagement"),
        SC.risk_percent("caption_raw", "neg", "like_raw", "comment_raw", "hashtag").alias("risk_yuzdesi"),
    )


def q_risk_documented(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", SC.risk_documented("neg", "neu", "pos", X.keyword_hits("caption", rules.KEYWORDS_V2))
                    .alias("risk_documented"))


def q_video_risk_face(spark, sf_dir):
    p = _posts(spark, sf_dir)
    face = X.to_bool("face_detected")
    return p.filter(F.col("face_detected").isNotNull() & face).select(
        "post_id", "face_emotion", "face_emotion_score",
        SC.face_video_risk("face_emotion", "face_emotion_score").alias("face_risk"),
    )


def q_video_risk_visual(spark, sf_dir):
    p = _posts(spark, sf_dir)
    face = X.to_bool("face_detected")
    return p.filter(F.col("face_detected").isNotNull() & ~face).select(
        "post_id",
        SC.visual_video_risk("visual_sad", "visual_angry", "visual_brightness", "visual_motion").alias("visual_risk"),
    )


def q_video_risk_policy(spark, sf_dir):
    p = _posts(spark, sf_dir)
    neutral = rules.RiskProfile(missing_video="neutral")
    return p.select(
        "post_id",
        N.round_half_away(SC.video_risk(p), 3).alias("video_risk_reference"),
        N.round_half_away(SC.video_risk(p, neutral), 3).alias("video_risk_neutral"),
    )


def q_multimodal(spark, sf_dir):
    s = scored_posts(spark, sf_dir)
    return s.select("post_id", F.col("risk_score_v2").alias("text_risk"), F.col("rf_risk_score").alias("rf_risk"),
                    "video_risk", "mm_risk", "mm_risk_level")


def q_score_posts(spark, sf_dir):
    return scored_posts(spark, sf_dir)


def q_sentiment_scores(spark, sf_dir):
    p = _posts(spark, sf_dir)
    m = p.select("post_id", X.strip_ws(SC.merged_text("caption", "transcript")).alias("merged"))
    return SE.score_sentiment(m, "merged").select("post_id", "neg", "neu", "pos", "sentiment")


def q_clean_text(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", X.clean_text("caption").alias("caption_clean"),
                    X.clean_text("transcript").alias("transcript_clean"))


def q_clean_caption(spark, sf_dir):
    r = _raw_posts(spark, sf_dir)
    return r.select("post_id", X.clean_caption("caption_raw").alias("caption_reference"),
                    X.clean_caption("caption_raw", "documented").alias("caption_documented"))


def q_softmax3(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    a = F.col("value") / F.lit(10.0)
    b = (F.col("user_id") % 7).cast("double") / F.lit(3.0)
    c = (F.col("event_id") % 5).cast("double") * F.lit(0.5)
    p = ev.select("event_id", N.softmax3(a, b, c).alias("p"))
    ps = [F.col("p")[i] for i in range(3)]
    return p.select(
        "event_id",
        N.round_half_away(ps[0], 6).alias("p_neg"),
        N.round_half_away(ps[1], 6).alias("p_neu"),
        N.round_half_away(ps[2], 6).alias("p_pos"),
        N.argmax3_label(ps[0], ps[1], ps[2]).alias("label"),
    )


def q_json_field(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def registry() -> dict[str, Query]:
    out: dict[str, Query] = {
        "posts_scan": q_posts_scan,
        "posts_union": q_posts_union,
        "keyword_hits": q_keyword_hits,
        "keyword_hits_join": q_keyword_hits_join,
        "passage_posts": q_passage_posts,
        "tag_base_risk": q_tag_base_risk,
        "text_risk": q_text_risk,
        "percent_label": q_percent_label,
        "parse_counts": q_parse_counts,
        "to_bool": q_to_bool,
        "risk_percent": q_risk_percent,
        "risk_documented": q_risk_documented,
        "video_risk_face": q_video_risk_face,
        "video_risk_visual": q_video_risk_visual,
        "video_risk_policy": q_video_risk_policy,
        "multimodal": q_multimodal,
        "score_posts": q_score_posts,
        "sentiment_scores": q_sentiment_scores,
        "clean_text": q_clean_text,
        "clean_caption": q_clean_caption,
        "softmax3": q_softmax3,
        "json_field": q_json_field,
    }
    from riskspark.plans import queries_features, queries_more, queries_training

    out.update(queries_more.registry())
    out.update(queries_features.registry())
    out.update(queries_training.registry())
    return out
