"""Stored web pages -> links, post fields and comments.

Pages are rows (page_id, url, html).  Every page is parsed once, in its own
row (``mapInArrow``, no shuffle), as a browser reads it: nested elements,
either quote style, attributes in any order, character references; comments
and script text hold no elements.  A selector is a (tag, attribute, value)
triple standing for ``tag[attribute="value"]``; the tag or the attribute
may be None.  The text of an element is that of everything inside it.

Defined cases: a null or empty page has no elements; an element never
closed ends with its parent; a null url leaves links as they are written;
so does a link that is no valid URL; a page that cannot be read or parsed
(bytes that are no UTF-8, say) costs itself only: it gives no links, fields
or comments, and ``page_failures`` lists it with its error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import rules
from riskspark.functions import text as X

# ---------------------------------------------------------------------------
# Selectors and link pattern of the collector
# ---------------------------------------------------------------------------
CAPTION_SELECTORS = (
    ("div", "data-e2e", "browse-video-desc"),
    ("h1", "data-e2e", "browse-video-desc"),
    ("div", "data-e2e", "video-desc"),
    ("h1", "data-e2e", "video-desc"),
    ("span", "data-e2e", "video-desc"),
)
LIKE_SELECTOR = ("strong", "data-e2e", "like-count")
COMMENT_SELECTOR = ("strong", "data-e2e", "comment-count")
COMMENT_TEXT_SELECTOR = (None, "data-e2e", "comment-text")
VIDEO_LINK_CONTAINS = "/video/"
TAG_URL_PATTERN = r"/tag/([^/?#]+)"

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# start tags that end an open paragraph or list item directly around them
_ENDS = {"p": frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section", "article",
                         "header", "footer", "nav", "form", "pre", "blockquote")),
         "li": frozenset(("li",))}


class _Page(HTMLParser):
    """One page: texts of the elements of each selector in document order,
    hrefs of its links, and its named meta contents."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.texts: list[list[list[str]]] = [[] for _ in selectors]
        self.hrefs: list[str] = []
        self.meta: dict[str, str] = {}
        self.open: list[tuple[str, list[list[str]]]] = []   # open elements and the texts they collect
        self.collecting: list[list[str]] = []               # those texts, outer elements first
        self.depth: Counter[str] = Counter()                # open elements by tag

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)          # as browsers do; the base class may stop the page

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")                        # the first of repeated attributes counts
        if tag == "a" and "href" in a:
            self.hrefs.append(a["href"])
        elif tag == "meta" and "name" in a and "content" in a:
            self.meta.setdefault(a["name"], a["content"])
        if self.open and tag in _ENDS.get(self.open[-1][0], ()):
            self._close(len(self.open) - 1)
        found = []
        for (t, k, v), texts in zip(self.selectors, self.texts):
            if (t is None or t == tag) and (k is None or a.get(k) == v):
                found.append([])
                texts.append(found[-1])
        if tag not in _VOID:
            self.open.append((tag, found))
            self.collecting += found
            self.depth[tag] += 1

    def _close(self, at):
        """Ends the open elements from number ``at`` on."""
        for tag, found in self.open[at:]:
            self.depth[tag] -= 1
            if found:
                del self.collecting[-len(found):]
        del self.open[at:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)                    # a closing slash means nothing in HTML

    def handle_endtag(self, tag):
        if self.depth[tag]:                                 # an unmatched end tag costs nothing
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self._close(at)

    def handle_data(self, data):
        for t in self.collecting:
            t.append(data)


def absolute(base: str | None, href: str) -> str:
    """The link as a browser reports it (``a.href``)."""
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return href


PARSED = pa.struct([("texts", pa.list_(pa.list_(pa.string()))), ("links", pa.list_(pa.struct(
    [("pos", pa.int64()), ("href", pa.string()), ("link", pa.string())]))), ("meta", pa.string()), ("error", pa.string())])
_PARSED = T.StructType([
    T.StructField("texts", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("pos", T.LongType()), T.StructField("href", T.StringType()), T.StructField("link", T.StringType())]))),
    T.StructField("meta", T.StringType()), T.StructField("error", T.StringType())])


def parse_pages(pages: DataFrame, selectors=(), contains: str | None = None, meta: str | None = None,
                first_only: bool = True, keep=("page_id",)) -> DataFrame:
    """``keep`` columns plus ``page``: for every selector its elements' texts
    (the first element's only, with ``first_only``), the links whose href
    contains ``contains`` (none, if None) with their position among the links
    of the page, and the content of the meta element named ``meta``.  A page
    that cannot be read has empty ones of these and its error in ``page.error``
    (NULL otherwise)."""
    selectors, keep = [tuple(s) for s in selectors], list(keep)

    def one(url: str | None, html: str | None) -> dict:
        p = _Page(selectors)
        p.feed(html or "")
        p.close()
        links = [{"pos": i, "href": h, "link": absolute(url, h)} for i, h in enumerate(p.hrefs)
                 if contains is not None and contains in h]
        texts = [["".join(t) for t in (found[:1] if first_only else found)] for found in p.texts]
        return {"texts": texts, "links": links, "meta": p.meta.get(meta, ""), "error": None}

    def tried(url: pa.Scalar, html: pa.Scalar) -> dict:
        try:
            return one(url.as_py(), html.as_py())
        except Exception as e:  # whatever is wrong with one page is reported in its row
            return {"texts": [[] for _ in selectors], "links": [], "meta": "", "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            rows = [tried(u, h) for u, h in zip(batch.column(n), batch.column(n + 1))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(rows, PARSED)],
                                             names=[*keep, "page"])

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("page", _PARSED)])
    return pages.select(*keep, F.col("url").alias("__url"), F.col("html").alias("__html")).mapInArrow(run, schema)


def first_nonblank(*cols: Column) -> Column:
    """First value that is non-blank after strip (stripped), else ''."""
    return F.coalesce(*[F.nullif(X.strip_ws(c), F.lit("")) for c in cols], F.lit(""))


def page_fields(pages: DataFrame, caption_selectors=CAPTION_SELECTORS, meta_fallback: str | None = "description",
                like_selector=LIKE_SELECTOR, comment_selector=COMMENT_SELECTOR) -> DataFrame:
    """(page_id, url, caption, like_raw, comment_raw) from stored HTML.

    Caption: the first selector whose first element's text is non-blank, then
    the meta description, then ''.  Counts: stripped text of their element
    ('' if absent)."""
    selectors = [*caption_selectors, like_selector, comment_selector]
    p = parse_pages(pages, selectors, meta=meta_fallback, keep=("page_id", "url")).where("page.error IS NULL")
    first = [F.get(F.get("page.texts", F.lit(i)), F.lit(0)) for i in range(len(selectors))]
    return p.select(
        "page_id", "url",
        first_nonblank(*first[:-2], F.col("page.meta")).alias("caption"),
        *[F.coalesce(X.strip_ws(c), F.lit("")).alias(name) for c, name in zip(first[-2:], ("like_raw", "comment_raw"))])


def page_failures(pages: DataFrame) -> DataFrame:
    """(page_id, url, error) of the pages that cannot be read or parsed: the
    table to write beside the results, so that a job goes on without them."""
    p = parse_pages(pages, keep=("page_id", "url"))
    return p.where("page.error IS NOT NULL").select("page_id", "url", F.col("page.error").alias("error"))


def page_status(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_failed): pages of each host and how many of them
    failed; pages without a host count under NULL."""
    p = parse_pages(pages, keep=("url",))
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host")
    return p.groupBy(host).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("page.error").isNotNull()).alias("n_failed"))


def page_comments(pages: DataFrame, selector=COMMENT_TEXT_SELECTOR) -> DataFrame:
    """(page_id, pos, text) of every element of ``selector``, in page order."""
    p = parse_pages(pages, [selector], first_only=False)
    return p.select("page_id", F.posexplode(F.get("page.texts", F.lit(0))).alias("pos", "text")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "text")


def page_links(pages: DataFrame, contains: str = VIDEO_LINK_CONTAINS, keep=()) -> DataFrame:
    """(page_id, pos, link): links of ``a[href*=contains]`` (the attribute text
    is matched, as a CSS selector does), made absolute against the page URL
    as ``a.href`` reports them, distinct per page at their first position
    (0-based among the links of the page)."""
    keep = list(keep)
    links = _matching_links(pages, contains, keep)
    return links.groupBy("page_id", *keep, "link").agg(F.min("pos").alias("pos")).select(
        "page_id", *keep, "pos", "link")


def _matching_links(pages: DataFrame, contains: str, keep: list) -> DataFrame:
    """Every matching link occurrence (page_id, keep..., pos, link), repeats included."""
    p = parse_pages(pages, contains=contains, keep=("page_id", *keep))
    return p.select("page_id", *keep, F.explode("page.links").alias("l")).select("page_id", *keep, "l.pos", "l.link")


def page_tag(url: Column, pattern: str = TAG_URL_PATTERN) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def hashtag_sample(pages: DataFrame, limit: int = rules.VIDEOS_PER_HASHTAG, contains: str = VIDEO_LINK_CONTAINS,
                   tag_pattern: str = TAG_URL_PATTERN) -> DataFrame:
    """(hashtag, rank, link, page_id, pos): the first ``limit`` distinct links
    per hashtag, in (page, position) order.

    Distinct per (hashtag, link) is shuffled on both columns, so a hashtag
    with most of the pages is still spread out; ``row_number() <= limit``
    becomes a partial ``WindowGroupLimit`` before the shuffle by hashtag, so
    a hot hashtag ships at most ``limit`` rows per map partition.  The
    first (page, position) of a link is one minimum over all its
    occurrences, so no per-page distinct step (and shuffle) comes first."""
    tagged = pages.select("page_id", "html", "url", page_tag(F.col("url"), tag_pattern).alias("hashtag")).filter(
        F.col("hashtag").isNotNull())
    first = _matching_links(tagged, contains, ["hashtag"]).groupBy("hashtag", "link").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    w = Window.partitionBy("hashtag").orderBy(F.col("at.page_id"), F.col("at.pos"), F.col("link"))
    return (first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(limit))
            .select("hashtag", F.col("rank").cast("bigint").alias("rank"), "link",
                    F.col("at.page_id").alias("page_id"), F.col("at.pos").alias("pos")))
