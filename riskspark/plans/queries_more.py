"""Registered queries, second part: comments, transcripts, pages, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import comments as CM
from riskspark.operators import report as RP
from riskspark.operators import transcripts as TR
from riskspark.sources import fixtures as FX
from riskspark.sources import pages as PG
from riskspark.sources.tables import read_table

# Fixture parameters for the stored pages (ours): the driver's pages carry
# no collector markup, so the tag is the first path segment, links are the
# hrefs containing "/t", and the caption chain is h1 -> title -> meta.
FIXTURE_TAG_PATTERN = r"^[a-zA-Z]+://[^/]+/([^/?#]+)/"
FIXTURE_LINK_CONTAINS = "/t"
FIXTURE_CAPTION_SELECTORS = (("h1", None, None), ("title", None, None))
DASH_FILTER_TAGS = ("depression", "suicide", "Selfharm")
DASH_SEARCH = "the|und"
TOP_K = 10
HEAD_ROWS = 5
PAGE_SIZE = 25
PAGE = 3
FIXTURE_COMMENT_SELECTOR = ("p", None, None)
FIXTURE_HOST_PATTERN = r"^[a-z]+://([^/?#]*)"


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def q_comment_topn(spark, sf_dir):
    return CM.comment_topn(FX.comments(spark, sf_dir))


def q_comment_risk(spark, sf_dir):
    return CM.comment_risk(FX.videos(spark, sf_dir), FX.comments(spark, sf_dir))


def q_transcript_build(spark, sf_dir):
    return TR.transcript_build(FX.segments(spark, sf_dir))


def q_page_links(spark, sf_dir):
    return PG.page_links(_pages(spark, sf_dir), FIXTURE_LINK_CONTAINS)


def q_hashtag_sample(spark, sf_dir):
    return PG.hashtag_sample(_pages(spark, sf_dir), contains=FIXTURE_LINK_CONTAINS, tag_pattern=FIXTURE_TAG_PATTERN)


def q_page_fields(spark, sf_dir):
    return PG.page_fields(_pages(spark, sf_dir), FIXTURE_CAPTION_SELECTORS)


def q_collect_pipeline(spark, sf_dir):
    """The whole collector job.  The given pages do not link to each other, so
    the page behind each matching link of a page is the page itself;
    conversations and frames of the same number are the video's speech and
    pictures."""
    from riskspark.operators.collector import collect

    pages = _pages(spark, sf_dir)
    links = PG.page_links(pages, FIXTURE_LINK_CONTAINS).select("page_id", F.col("link").alias("url")).distinct()
    stored = pages.drop("url").join(links, "page_id")
    return collect(pages, stored, FX.segments(spark, sf_dir), FX.frames(spark, sf_dir), contains=FIXTURE_LINK_CONTAINS,
                   tag_pattern=FIXTURE_TAG_PATTERN, caption_selectors=FIXTURE_CAPTION_SELECTORS)


def _view(spark, sf_dir):
    from riskspark.plans.queries import scored_posts

    return RP.dashboard_view(scored_posts(spark, sf_dir))


def q_dash_table(spark, sf_dir):
    return RP.data_table(RP.filter_hashtags(_view(spark, sf_dir)))


def q_dash_filter(spark, sf_dir):
    return RP.filter_hashtags(_view(spark, sf_dir), list(DASH_FILTER_TAGS)).select(
        "post_id", "hashtag", "mm_risk_score", "mm_level")


def q_dash_search(spark, sf_dir):
    v = RP.search_transcript(RP.filter_hashtags(_view(spark, sf_dir)), DASH_SEARCH)
    return v.select("post_id", "hashtag", "mm_level")


def q_dash_metrics(spark, sf_dir):
    return RP.metrics(RP.filter_hashtags(_view(spark, sf_dir)))


def q_dash_levels(spark, sf_dir):
    return RP.level_distribution(RP.filter_hashtags(_view(spark, sf_dir)))


def q_dash_hashtag(spark, sf_dir):
    return RP.hashtag_levels(RP.filter_hashtags(_view(spark, sf_dir)))


def q_dash_hashtags(spark, sf_dir):
    return RP.distinct_hashtags(_view(spark, sf_dir))


def q_dash_topk(spark, sf_dir):
    return RP.top_k(RP.filter_hashtags(_view(spark, sf_dir)), TOP_K)


def q_dash_sorted(spark, sf_dir):
    """The place of every row of the data table, sorted by text risk."""
    return RP.numbered(RP.filter_hashtags(_view(spark, sf_dir)), "text_risk_score", "post_id", ascending=False)


def q_dash_page(spark, sf_dir):
    """One page of the data table sorted by caption."""
    v = RP.filter_hashtags(_view(spark, sf_dir)).select("post_id", *RP.DASH_TABLE_COLS)
    return RP.table_page(v, "caption", PAGE, PAGE_SIZE)


def q_page_status(spark, sf_dir):
    return PG.page_status(_pages(spark, sf_dir))


def q_page_comment_risk(spark, sf_dir):
    """Comment risk of the stored pages: every page is a video, its host the
    tag; pages that cannot be read count as not reached.  The given pages hold
    no comment elements of the video site, so their paragraphs stand in."""
    pages = _pages(spark, sf_dir)
    failed = PG.page_failures(pages).select("page_id", F.lit("failed").alias("failed"))
    host = F.regexp_extract("url", FIXTURE_HOST_PATTERN, 1)
    videos = pages.select("page_id", host.alias("tag")).join(failed, "page_id", "left").select(
        "tag", "page_id", F.coalesce("failed", F.lit("ok")).alias("status"))
    return CM.comment_risk(videos, PG.page_comments(pages, FIXTURE_COMMENT_SELECTOR), video_col="page_id")


def q_csv_types(spark, sf_dir):
    """Documents and their labels written as CSV, and the types that the cells have."""
    import uuid

    from riskspark.session import ensure_checkpoint_dir
    from riskspark.sources import inferred as IN
    from riskspark.sources.tables import write_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"),
                                                        (F.col("quality") / 2.0).alias("half_quality"), "quality")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    write_table(docs.join(labels, "doc_id", "left"), path, fmt="csv")
    return IN.column_kinds(IN.read_raw(spark, path))


def q_sentiment_fitted(spark, sf_dir):
    """Every document scored by a model learned from labelled documents:
    toxic ones are negative, other good ones positive, the rest neutral.  A
    quarter of the ids is held out."""
    from riskspark.operators import sentiment as SE
    from riskspark.operators import sentiment_model as SM

    docs = FX.documents(spark, sf_dir, spread=True).select("doc_id", "text")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    labels = FX.sentiment_labels(spark, sf_dir).where(~held_out)
    model = SM.fit(docs.join(labels, "doc_id"))
    scored = SE.score_sentiment(docs.select("doc_id", "text", held_out), "text", model.make_scorer())
    return scored.select("doc_id", "held_out", *[F.round(c, 6).alias(c) for c in ("neg", "neu", "pos")], "sentiment")


def q_posts_head(spark, sf_dir):
    """The first rows of the scored table in post order (a head() with a
    stated order: TakeOrderedAndProject, k rows per partition merged)."""
    return _view(spark, sf_dir).orderBy("post_id").limit(HEAD_ROWS).select(
        "post_id", "hashtag", "caption", "mm_risk_score", "mm_level")


def q_label_counts(spark, sf_dir):
    from riskspark.plans.queries import scored_posts

    return RP.value_counts(scored_posts(spark, sf_dir), "rf_risk_label").select(
        F.col("rf_risk_label").alias("label"), "n")


def q_score_describe(spark, sf_dir):
    from riskspark.plans.queries import scored_posts

    return RP.describe(scored_posts(spark, sf_dir), "rf_risk_score")


def registry():
    return {
        "comment_topn": q_comment_topn,
        "comment_risk": q_comment_risk,
        "transcript_build": q_transcript_build,
        "page_links": q_page_links,
        "hashtag_sample": q_hashtag_sample,
        "page_fields": q_page_fields,
        "collect_pipeline": q_collect_pipeline,
        "dash_table": q_dash_table,
        "dash_filter": q_dash_filter,
        "dash_search": q_dash_search,
        "dash_metrics": q_dash_metrics,
        "dash_levels": q_dash_levels,
        "dash_hashtag": q_dash_hashtag,
        "dash_hashtags": q_dash_hashtags,
        "dash_topk": q_dash_topk,
        "dash_sorted": q_dash_sorted,
        "dash_page": q_dash_page,
        "page_status": q_page_status,
        "page_comment_risk": q_page_comment_risk,
        "csv_types": q_csv_types,
        "sentiment_fitted": q_sentiment_fitted,
        "posts_head": q_posts_head,
        "label_counts": q_label_counts,
        "score_describe": q_score_describe,
    }
