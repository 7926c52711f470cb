"""Risk rules as Column arithmetic, and the end-to-end post scoring.

Every rule here is a closed-form expression over one row, so scoring a
table is a single projection: scan -> project -> (optional model UDF) ->
project.  No shuffle, no driver round trip; Catalyst fuses the arithmetic
into one whole-stage-codegen span and prunes the columns it does not use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import text as X
from riskspark.operators import sentiment as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(cols) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


# --- text rules ------------------------------------------------------------

def tag_base_risk(hashtag, profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """Base risk by hashtag: lower-cased (not trimmed); NULL / other -> 0.20."""
    t = F.lower(F.coalesce(_c(hashtag), F.lit("")))
    expr = None
    for tag, val in profile.tag_base:
        expr = (F.when(t == F.lit(tag), F.lit(val)) if expr is None
                else expr.when(t == F.lit(tag), F.lit(val)))
    return expr.otherwise(F.lit(profile.tag_default))


def keyword_boost(hits) -> Column:
    """0 -> 0, 1 -> .15, 2 -> .25, >=3 -> .40."""
    h = _c(hits)
    b = rules.KEYWORD_BOOST
    return (F.when(h <= 0, F.lit(b[0])).when(h == 1, F.lit(b[1]))
            .when(h == 2, F.lit(b[2])).otherwise(F.lit(b[3])))


def adjust_with_sentiment(base, sentiment) -> Column:
    """NEG +0.10, POS -0.05, clamped."""
    b, s = _c(base), _c(sentiment)
    return N.clamp01(
        F.when(s == F.lit("NEG"), b + F.lit(rules.SENTIMENT_ADJUST_NEG))
        .when(s == F.lit("POS"), b + F.lit(rules.SENTIMENT_ADJUST_POS))
        .otherwise(b)
    )


def merged_text(caption, transcript) -> Column:
    """caption + " " + transcript with missing parts as "" (not stripped)."""
    return F.concat(F.coalesce(_c(caption), F.lit("")), F.lit(" "), F.coalesce(_c(transcript), F.lit("")))


def text_risk(hashtag, sentiment, caption, transcript,
              profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """clamp(adjust(base(tag), sentiment) + boost(hits(lower(caption+" "+transcript))))."""
    hits = X.keyword_hits(merged_text(caption, transcript), profile.keywords_v2)
    return text_risk_from(hashtag, sentiment, hits, profile)


def text_risk_from(hashtag, sentiment, hits, profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    base = adjust_with_sentiment(tag_base_risk(hashtag, profile), sentiment)
    return N.clamp01(base + keyword_boost(hits))


# --- caption-level percent score -------------------------------------------

def keyword_risk_from_hits(hits) -> Column:
    """0 if no hits else min(1, hits / 3)."""
    h = _c(hits)
    return F.when(h == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), h.cast("double") / F.lit(3.0)))


def keyword_risk_v1(text, profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """0 if no hits else min(1, hits / 3)."""
    return keyword_risk_from_hits(X.keyword_hits(text, profile.keywords_v1))


def engagement_risk(likes, comments) -> Column:
    """total <= 0 -> 0, else clamp(total / 100000)."""
    total = _c(likes).cast("double") + _c(comments).cast("double")  # two large counts overflow a BIGINT
    return F.when(total <= 0, F.lit(0.0)).otherwise(
        N.clamp01(total / F.lit(rules.ENGAGEMENT_SCALE))
    )


def risk_percent(caption, neg, like_raw, comment_raw, hashtag,
                 profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """clamp(.5 neg + .3 kw + .2 engagement + .15 bonus tag) * 100, 2 places.

    For whole tables prefer ``with_risk_percent``, which computes the parsed
    counts and hits once as columns before the arithmetic."""
    return risk_percent_from(X.keyword_hits(caption, profile.keywords_v1), neg,
                             X.parse_count(like_raw), X.parse_count(comment_raw), hashtag, profile)


def risk_percent_from(hits, neg, likes, comments, hashtag,
                      profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """The percent score from keyword hits (v1 list) and parsed counts."""
    kw = keyword_risk_from_hits(hits)
    eng = engagement_risk(likes, comments)
    tag = F.lower(_c(hashtag))
    bonus = F.when(tag.isin(*profile.bonus_tags), F.lit(rules.BONUS_TAG_VALUE)).otherwise(F.lit(0.0))
    raw = (F.lit(rules.PCT_W_NEG) * _c(neg) + F.lit(rules.PCT_W_KEYWORD) * kw
           + F.lit(rules.PCT_W_ENGAGEMENT) * eng + bonus)
    return N.round_half_away(N.clamp01(raw) * F.lit(100.0), 2)


def risk_documented(neg, neu, pos, hits) -> Column:
    """The described alternative: .6 neg + .2 neu + 0 pos + .15 per hit, unclamped."""
    return (F.lit(rules.DOC_W_NEG) * _c(neg) + F.lit(rules.DOC_W_NEU) * _c(neu)
            + F.lit(rules.DOC_W_POS) * _c(pos) + F.lit(rules.DOC_W_HIT) * _c(hits).cast("double"))


# --- video rules -----------------------------------------------------------

def emotion_base(emotion) -> Column:
    e = F.lower(F.coalesce(_c(emotion), F.lit("")))
    return (F.when(e.isin(*rules.EMOTION_HIGH), F.lit(rules.EMOTION_HIGH_VALUE))
            .when(e == F.lit("neutral"), F.lit(rules.EMOTION_NEUTRAL_VALUE))
            .when(e == F.lit("happy"), F.lit(rules.EMOTION_HAPPY_VALUE))
            .otherwise(F.lit(rules.EMOTION_OTHER_VALUE)))


def face_video_risk(emotion, score, missing_as_max: bool = True) -> Column:
    """.5 base(emotion) + .5 clamp(score, read as percent above 1.5).

    A missing score is NaN in the reproduced behaviour and clamps to 1.0
    (``missing_as_max``); otherwise it stays NULL.  A cell that is no number
    counts as 0."""
    s = N.safe_float(_c(score), 0.0)
    s = F.when(s > F.lit(rules.FACE_PERCENT_CUTOFF), s / F.lit(100.0)).otherwise(s)
    s = N.clamp01(s)
    if missing_as_max:
        s = F.coalesce(s, F.lit(1.0))
    return N.clamp01(F.lit(0.5) * emotion_base(emotion) + F.lit(0.5) * s)


def visual_video_risk(sad, angry, brightness, motion, missing_as_max: bool = True) -> Column:
    """.45 sad + .25 angry + .20 (1 - clamp(bright/255)) + .10 clamp(motion/20).

    With ``missing_as_max`` a missing value behaves like the NaN it is in the
    reproduced behaviour: sad/angry NaN -> 1.0, brightness NaN -> dull 0,
    motion NaN -> 1.  A cell that is no number takes its default: 0, for
    brightness 128."""
    vs, va = N.safe_float(_c(sad), 0.0), N.safe_float(_c(angry), 0.0)
    vb, vm = N.safe_float(_c(brightness), rules.VISUAL_DEFAULT_BRIGHTNESS), N.safe_float(_c(motion), 0.0)
    bright_norm = N.clamp01(vb / F.lit(rules.VISUAL_BRIGHT_SCALE))
    motion_norm = N.clamp01(vm / F.lit(rules.VISUAL_MOTION_SCALE))
    if missing_as_max:
        bright_norm = F.coalesce(bright_norm, F.lit(1.0))
        motion_norm = F.coalesce(motion_norm, F.lit(1.0))
    dull = F.lit(1.0) - bright_norm
    vr = (F.lit(rules.VISUAL_W_SAD) * vs + F.lit(rules.VISUAL_W_ANGRY) * va
          + F.lit(rules.VISUAL_W_DULL) * dull + F.lit(rules.VISUAL_W_MOTION) * motion_norm)
    out = N.clamp01(vr)
    if missing_as_max:
        out = F.coalesce(out, F.lit(1.0))
    return out


def video_risk(df: DataFrame, profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """Video risk of a post from face or atmosphere columns.

    Policy ``reference``: a post without video (all video columns missing)
    reads as face found with unknown emotion and score -> 0.7; face not found
    with missing visuals -> 1.0.  Policy ``neutral``: anything missing -> 0.5.
    Columns absent from the table take the reproduced defaults (no face;
    sad 0, angry 0, brightness 128, motion 0).
    """
    have = set(df.columns)

    def col_or(name, default):
        return F.col(name) if name in have else F.lit(default)

    fd_raw = col_or("face_detected", None)
    fd_type = df.schema["face_detected"].dataType if "face_detected" in have else T.StringType()
    reference = profile.missing_video == "reference"
    if "face_detected" in have:
        face = X.to_bool(fd_raw, fd_type, null_as=True if reference else None)
    else:
        face = F.lit(False)
    emo = col_or("face_emotion", None).cast("string")
    score = col_or("face_emotion_score", 0.0)
    sad = col_or("visual_sad", 0.0)
    angry = col_or("visual_angry", 0.0)
    bright = col_or("visual_brightness", rules.VISUAL_DEFAULT_BRIGHTNESS)
    motion = col_or("visual_motion", 0.0)
    vr = F.when(face, face_video_risk(emo, score, reference)).otherwise(
        visual_video_risk(sad, angry, bright, motion, reference)
    )
    if reference:
        return vr
    return F.when(face.isNull(), F.lit(0.5)).otherwise(F.coalesce(vr, F.lit(0.5)))


# --- model score and fusion --------------------------------------------------

def rf_score(p_high, p_low, p_medium) -> Column:
    """.1 P(LOW) + .5 P(MEDIUM) + 1.0 P(HIGH); a missing class counts 0."""
    lo = F.coalesce(_c(p_low), F.lit(0.0))
    me = F.coalesce(_c(p_medium), F.lit(0.0))
    hi = F.coalesce(_c(p_high), F.lit(0.0))
    return lo * F.lit(rules.RF_W_LOW) + me * F.lit(rules.RF_W_MEDIUM) + hi * F.lit(rules.RF_W_HIGH)


def rf_label(p_high, p_low, p_medium) -> Column:
    """Predicted class: argmax in encoder order HIGH, LOW, MEDIUM; ties to the first."""
    return N.argmax3_label(p_high, p_low, p_medium, rules.LEVELS)


def fuse(text, rf, video) -> Column:
    """clamp(.45 text + .35 rf + .20 video) on unrounded inputs."""
    return N.clamp01(F.lit(rules.FUSION_W_TEXT) * _c(text) + F.lit(rules.FUSION_W_RF) * _c(rf)
                     + F.lit(rules.FUSION_W_VIDEO) * _c(video))


# --- jobs --------------------------------------------------------------------

def with_risk_percent(df: DataFrame, caption: str, neg: str, like_raw: str, comment_raw: str, hashtag: str,
                      out: str = "risk_yuzdesi", profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> DataFrame:
    """Adds the percent score.  The parsed counts and the keyword hits are
    columns of their own first: each is referenced several times by the
    arithmetic, so Catalyst keeps that projection separate and evaluates
    the count parser and the 18 substring tests once per row."""
    staged = df.withColumns({
        "__hits1": X.keyword_hits(F.col(caption), profile.keywords_v1),
        "__likes": X.parse_count(like_raw),
        "__comments": X.parse_count(comment_raw),
    })
    return staged.withColumn(out, risk_percent_from("__hits1", neg, "__likes", "__comments", hashtag, profile)).drop(
        "__hits1", "__likes", "__comments")


def collect_posts(raw: DataFrame, profile: rules.RiskProfile = rules.DEFAULT_PROFILE,
                  make_scorer: Callable | None = None) -> DataFrame:
    """Collector step: caption sentiment and the 0-100 percent score from the
    *raw* caption, then the stored caption is the cleaned one."""
    scored = S.score_sentiment(raw, "caption_raw", make_scorer, labels=rules.SENTIMENT_WORDS,
                               prefix="", profile=profile)
    scored = with_risk_percent(scored, "caption_raw", "neg", "like_raw", "comment_raw", "hashtag", profile=profile)
    return scored.select(
        "post_id", "hashtag",
        X.clean_caption("caption_raw").alias("caption"),
        "like_raw", "comment_raw", "sentiment", "neg", "neu", "pos", "risk_yuzdesi",
        "transcript", "summary", "video_url", "face_detected", "face_emotion",
        "face_emotion_score", "visual_happy", "visual_sad", "visual_angry", "visual_calm",
        "visual_blur", "visual_brightness", "visual_motion",
    )


def score_posts(posts: DataFrame, rf_probability: Column | None = None,
                profile: rules.RiskProfile = rules.DEFAULT_PROFILE,
                make_scorer: Callable | None = None, rf_model=None) -> DataFrame:
    """Append the nine scoring columns to a posts table.

    ``rf_probability``: ARRAY<DOUBLE> [P(HIGH), P(LOW), P(MEDIUM)] column; or
    ``rf_model``: a fitted text pipeline (see ``operators.training``) whose
    probability vector is read the same way.  Levels come from unrounded
    scores; stored scores are rounded to 3 places afterwards.
    """
    base_cols = list(posts.columns)
    cap = F.coalesce(F.col("caption"), F.lit(""))
    tr = F.coalesce(F.col("transcript"), F.lit(""))
    df = posts.withColumn("__merged", X.strip_ws(F.concat(cap, F.lit(" "), tr)))
    if rf_model is not None:
        from riskspark.operators.training import rf_probability_columns

        from riskspark.operators.features import model_text

        # the same text expression the model was trained on (no train/serve skew)
        df = rf_probability_columns(rf_model, df.withColumn("__model_text", model_text(posts)), "__model_text")
        rf_probability = F.col("__rf_probs")
    if rf_probability is None:
        raise ValueError("score_posts needs rf_probability or rf_model")
    df = S.score_sentiment(df, "__merged", make_scorer, prefix="__s_", profile=profile)
    df = df.withColumns({
        "__hits2": X.keyword_hits(merged_text("caption", "transcript"), profile.keywords_v2),
        "__rfp": rf_probability,
        "__video": video_risk(posts, profile),
    })
    df = df.withColumn("__text", text_risk_from("hashtag", "__s_sentiment", "__hits2", profile))
    p = [F.col("__rfp")[i] for i in range(3)]
    df = df.withColumns({
        "__rf": rf_score(p[0], p[1], p[2]),
        "__rf_label": rf_label(p[0], p[1], p[2]),
    })
    df = df.withColumn("__mm", fuse("__text", "__rf", "__video"))
    return df.select(
        *base_cols,
        F.col("__s_sentiment").alias("sentiment_v2"),
        F.col("__text").alias("risk_score_v2"),
        N.round_half_away("__text", 3).alias("risk_numeric"),
        N.risk_level("__text").alias("risk_level_v2"),
        F.col("__rf_label").alias("rf_risk_label"),
        F.col("__rf").alias("rf_risk_score"),
        N.round_half_away("__video", 3).alias("video_risk"),
        N.round_half_away("__mm", 3).alias("mm_risk"),
        N.risk_level("__mm").alias("mm_risk_level"),
    )
