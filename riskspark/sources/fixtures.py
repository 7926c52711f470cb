"""Derived tables over the driver's parquet tables.

The driver ships TPC-H-style tables plus ``documents``, ``labels``, ``pages``,
``conversations``, ``embeddings`` and ``events``.  The jobs here need posts,
videos, comments, transcript segments and frames; each is derived with
column arithmetic from a driver table, row for row, so its size grows with
the input.  Every derivation is also written as SQL in ``plans/oracle.py``.

Posts (from ``documents``): the whole text is used -- the first line is the
caption, the rest is the transcript -- with a risk keyword, and sometimes a
URL / @mention / #hashtag, appended to the caption so the keyword rules have
something to find.  Face and visual columns come from ``doc_id`` arithmetic,
including missing-video rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.sources.tables import read_table, spread_scan

# ---------------------------------------------------------------------------
# Fixed values of the fixture derivation (ours)
# ---------------------------------------------------------------------------
FIXTURE_HASHTAGS = ("depression", "anxiety", "suicide", "psychosis", "Selfharm", None)
FIXTURE_SUFFIXES = rules.KEYWORDS_V2 + ("", "", "")  # 26 entries
FIXTURE_FACE_FLAGS = ("True", "False", " yes ", "0", "1")  # by doc_id % 5
FIXTURE_EMOTIONS = ("sad", "fear", "angry", "disgust", "neutral", "happy", "surprise", None)
VIDEO_URL_PREFIX = "https://video.example/v/"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _pick(values, idx: Column) -> Column:
    """values[idx] for a 0-based BIGINT index."""
    return F.element_at(_lit_array(values), (idx + F.lit(1)).cast("int"))


def _count_text(k: Column, n: Column) -> Column:
    """Engagement count text in the formats a page shows ("1.2K", "1,234" ...)."""
    s = lambda c: c.cast("string")
    m = k % 8
    return (
        F.when(m == 0, F.lit(None).cast("string"))
        .when(m == 1, s(n))
        .when(m == 2, F.concat(s(k % 10), F.lit("."), s(k % 7), F.lit("K")))
        .when(m == 3, F.concat(s(k % 10), F.lit(","), s(k % 9), F.lit("k")))
        .when(m == 4, F.concat(s(k % 5), F.lit("M")))
        .when(m == 5, F.concat(F.lit("1,"), F.lpad(s(k % 1000), 3, "0")))
        .when(m == 6, F.concat(F.lit(" "), s(n % 500), F.lit(" ")))
        .otherwise(F.lit("n/a"))
    )


def raw_posts(documents: DataFrame) -> DataFrame:
    """Collected post fields before the collector's caption scoring.

    Columns: post_id, hashtag, caption_raw, like_raw, comment_raw, transcript,
    summary, video_url, face_* and visual_*.
    """
    d = F.col("doc_id")
    text = F.col("text")
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    rest = F.substr(text, F.length(first) + F.lit(2))
    kw = _pick(FIXTURE_SUFFIXES, d % 26)
    extra = (
        F.when(d % 7 == 0, F.concat(F.lit(" http://t.example/v/"), d.cast("string")))
        .when(d % 7 == 1, F.concat(F.lit(" @user"), d.cast("string")))
        .when(d % 7 == 2, F.concat(F.lit(" #tag"), d.cast("string")))
        .otherwise(F.lit(""))
    )
    lead = F.when(d % 5 == 0, F.lit("  ")).otherwise(F.lit(""))
    caption_raw = F.when(d % 17 == 16, F.lit(None).cast("string")).otherwise(
        F.concat(lead, first, F.when(kw == "", F.lit("")).otherwise(F.concat(F.lit(" "), kw)), extra)
    )
    transcript = F.when(d % 10 == 0, F.lit(None).cast("string")).otherwise(F.nullif(rest, F.lit("")))
    has_video = d % 9 != 8
    face = (d % 5).isin(0, 2, 4)  # the flags that read as true
    dbl = lambda c: c.cast("double")
    visual_ok = has_video & ~face & (d % 7 != 3)

    def visual(expr: Column) -> Column:
        return F.when(visual_ok, expr)

    return documents.select(
        d.alias("post_id"),
        _pick(FIXTURE_HASHTAGS, d % 6).alias("hashtag"),
        caption_raw.alias("caption_raw"),
        _count_text(d, F.col("n_chars")).alias("like_raw"),
        _count_text(d + 3, F.col("n_chars") % 1000).alias("comment_raw"),
        transcript.alias("transcript"),
        F.substr(transcript, F.lit(1), F.lit(rules.SUMMARY_CHARS)).alias("summary"),
        F.concat(F.lit(VIDEO_URL_PREFIX), d.cast("string")).alias("video_url"),
        F.when(has_video, _pick(FIXTURE_FACE_FLAGS, d % 5)).alias("face_detected"),
        F.when(has_video & face, _pick(FIXTURE_EMOTIONS, d % 8)).alias("face_emotion"),
        F.when(~has_video, F.lit(None).cast("double"))
        .when(face & (d % 13 == 0), F.lit(None).cast("double"))
        .when(face & (d % 3 == 0), dbl(d % 100) / F.lit(100.0))
        .when(face, dbl(d % 101))
        .otherwise(F.lit(0.0))
        .alias("face_emotion_score"),
        visual(dbl((d * 11) % 100) / F.lit(100.0)).alias("visual_happy"),
        visual(dbl((d * 7) % 100) / F.lit(100.0)).alias("visual_sad"),
        visual(dbl((d * 3) % 60) / F.lit(100.0)).alias("visual_angry"),
        visual(dbl((d * 13) % 100) / F.lit(100.0)).alias("visual_calm"),
        visual(dbl((d * 17) % 300)).alias("visual_blur"),
        visual(dbl((d * 19) % 256)).alias("visual_brightness"),
        visual(dbl(d % 30)).alias("visual_motion"),
    )


def documents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(doc_id, text, n_chars); with ``spread`` and a number in the session's
    ``spark.riskspark.scanPartitions`` the scan is spread over so many hash
    partitions of doc_id first (see ``tables.spread_scan``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    n = spark.conf.get("spark.riskspark.scanPartitions", None) if spread else None
    return spread_scan(docs, "doc_id", int(n) if n else None)


def posts(spark: SparkSession, sf_dir: str, profile: rules.RiskProfile = rules.DEFAULT_PROFILE,
          spread: bool = False) -> DataFrame:
    """The collector's posts table (canonical ``schemas.POSTS`` columns)."""
    from riskspark.operators.scoring import collect_posts

    return collect_posts(raw_posts(documents(spark, sf_dir, spread)), profile)


def fixture_rf_probability(post_id) -> Column:
    """Stand-in forest output [P(HIGH), P(LOW), P(MEDIUM)] from id arithmetic,
    for oracle-checkable scoring without a fitted model."""
    p = F.col(post_id) if isinstance(post_id, str) else post_id
    a = (p % 5).cast("double")
    b = (p % 3 + 1).cast("double")
    c = (p % 4).cast("double")
    s = a + b + c
    return F.array(a / s, b / s, c / s)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos to visit: tag, video_url and whether the page could be reached."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(
        _pick(FIXTURE_HASHTAGS, d % 6).alias("tag"),
        F.concat(F.lit(VIDEO_URL_PREFIX), d.cast("string")).alias("video_url"),
        F.when(d % 11 == 10, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in page order: user turns of ``conversations`` (conv_id is the
    video, turn the position), plus a re-shown copy of some comments with
    trailing whitespace, and a blank comment on some videos."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    url = F.concat(F.lit(VIDEO_URL_PREFIX), F.col("conv_id").cast("string"))
    user = conv.filter(F.col("role") == "user")
    base = user.select(url.alias("video_url"), F.col("turn").alias("pos"), F.col("text"))
    copies = user.filter(F.col("conv_id") % 3 == 0).select(
        url.alias("video_url"), (F.col("turn") + 50).alias("pos"), F.concat(F.col("text"), F.lit(" \n")).alias("text")
    )
    blanks = user.filter((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)).select(
        url.alias("video_url"), F.lit(99).cast("bigint").alias("pos"), F.lit("   ").alias("text")
    )
    return base.unionByName(copies).unionByName(blanks)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments: every conversation turn, in turn order."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return conv.select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seg"), F.col("text")
    )


FRAMES_PER_VIDEO = 20
FRAME_SIDE = 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray frames from 64-float embeddings: gray = floor((x+1)*127.5)
    clamped to 0..255; 20 consecutive vectors make one video."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    gray = F.transform(
        F.col("embedding"),
        lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("int"))),
    )
    return emb.select(
        F.floor(F.col("vec_id") / F.lit(FRAMES_PER_VIDEO)).cast("bigint").alias("video_id"),
        (F.col("vec_id") % FRAMES_PER_VIDEO).alias("frame"),
        F.lit(FRAME_SIDE).alias("width"),
        F.lit(FRAME_SIDE).alias("height"),
        gray.alias("gray"),
    )


def colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray frames as colour ones: of the k-th gray value x the pixel
    (blue x, green 255 - x, red (7 x + 3 k) % 256), interleaved."""
    gray = frames(spark, sf_dir)
    pixel = F.transform("gray", lambda x, k: F.array(x, F.lit(255) - x, ((x * 7 + k * 3) % 256).cast("int")))
    return gray.select("video_id", "frame", "width", "height", F.flatten(pixel).alias("bgr"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True labels: toxic -> HIGH; else low quality -> MEDIUM; else LOW."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lab.select(
        F.col("doc_id").alias("post_id"),
        F.when(F.col("toxic") == 1, F.lit("HIGH"))
        .when(F.col("quality") == 0, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
        .alias("true_label"),
    )



def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label): toxic -> NEG; else good quality -> POS; else NEU."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lab.select("doc_id", F.when(F.col("toxic") == 1, F.lit("NEG")).when(F.col("quality") == 1, F.lit("POS"))
                      .otherwise(F.lit("NEU")).alias("label"))
