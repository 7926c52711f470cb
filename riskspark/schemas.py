"""Canonical schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


POSTS = _struct(
    ("post_id", L), ("hashtag", S), ("caption", S), ("like_raw", S), ("comment_raw", S),
    ("sentiment", S), ("neg", D), ("neu", D), ("pos", D), ("risk_yuzdesi", D),
    ("transcript", S), ("summary", S), ("video_url", S),
    ("face_detected", S), ("face_emotion", S), ("face_emotion_score", D),
    ("visual_happy", D), ("visual_sad", D), ("visual_angry", D), ("visual_calm", D),
    ("visual_blur", D), ("visual_brightness", D), ("visual_motion", D),
)

SCORED_EXTRA = _struct(
    ("sentiment_v2", S), ("risk_score_v2", D), ("risk_numeric", D), ("risk_level_v2", S),
    ("rf_risk_label", S), ("rf_risk_score", D), ("video_risk", D), ("mm_risk", D),
    ("mm_risk_level", S),
)

VIDEO_RISK = _struct(
    ("tag", S), ("video_url", S), ("n_comments", L), ("neg_count", L), ("neu_count", L),
    ("pos_count", L), ("risk_score", D), ("risk_level", S),
)

COMMENTS = _struct(("video_url", S), ("pos", L), ("text", S))
SEGMENTS = _struct(("video_id", L), ("seg", L), ("text", S))
FRAMES = _struct(("video_id", L), ("frame", L), ("width", T.IntegerType()),
                 ("height", T.IntegerType()), ("gray", T.ArrayType(T.IntegerType())))
PAGES = _struct(("page_id", L), ("url", S), ("html", S))
TRAINING = _struct(("text", S), ("label", S))


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise one clear error naming every missing column."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; present: {sorted(have)}")


def available_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The subset of ``names`` present in ``df``, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]
