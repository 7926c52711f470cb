"""Page extraction with the collector's selectors on inline HTML."""

import pytest

from riskspark.sources import pages as PG

HTML = (
    '<html><head><meta name="description" content="meta text &amp; more"><title>T</title></head><body>'
    '<a href="/video/1">x</a><a class="c" href="https://h.example/video/2?a=1&amp;b=2">y</a>'
    '<a href="/video/1">again</a><a href="/other">z</a><a href="video/3">rel</a>'
    '<div data-e2e="browse-video-desc">  </div>'
    '<h1 data-e2e="video-desc">Caption <b>bold</b> &lt;3 </h1>'
    '<strong data-e2e="like-count"> 1.2K </strong><strong data-e2e="comment-count">34</strong>'
    '<p data-e2e="comment-text">first</p><span data-e2e="comment-text">second</span>'
    '</body></html>'
)


def _pages(spark, html=HTML, url="https://www.site.example/tag/sad"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_page_fields_chain_and_counts(spark):
    r = PG.page_fields(_pages(spark)).first()
    assert r.caption == "Caption bold <3"   # first selector is blank -> next one
    assert (r.like_raw, r.comment_raw) == ("1.2K", "34")
    no_caption = HTML.replace('<h1 data-e2e="video-desc">Caption <b>bold</b> &lt;3 </h1>', "")
    assert PG.page_fields(_pages(spark, no_caption)).first().caption == "meta text & more"


def test_links_in_order_distinct_absolute(spark):
    got = PG.page_links(_pages(spark)).orderBy("pos").collect()
    assert [(r.pos, r.link) for r in got] == [
        (0, "https://www.site.example/video/1"),
        (1, "https://h.example/video/2?a=1&b=2"),
    ]  # "video/3" has no "/video/" in its attribute text, so the selector skips it
    rel = PG.page_links(_pages(spark), contains="video/3").first()
    assert rel.link == "https://www.site.example/tag/video/3"


def test_hashtag_sample_limit(spark):
    html = "".join(f'<a href="/video/{i}">v</a>' for i in range(6))
    got = PG.hashtag_sample(_pages(spark, html)).orderBy("rank").collect()
    assert [r.hashtag for r in got] == ["sad"] * 3
    assert [r.link.rsplit("/", 1)[1] for r in got] == ["0", "1", "2"]


def test_comments_of_a_page_in_order(spark):
    got = PG.page_comments(_pages(spark)).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "first"), (1, "second")]


@pytest.mark.parametrize("html,caption", [
    ('<div data-e2e="browse-video-desc"><div>one</div> two</div>', "one two"),
    ("<div data-e2e='browse-video-desc'>caf&eacute; it&#x27;s</div>", "caf\u00e9 it's"),
    ('<!-- <div data-e2e="browse-video-desc">no</div> --><span data-e2e="video-desc">yes</span>', "yes"),
    ('<meta content="late name" name="description">', "late name"),
    ('<div data-e2e="browse-video-desc">open', "open"),
    ('<![odd[> <div data-e2e="browse-video-desc">x</div>', "x"),
    ("", ""), (None, ""),
])
def test_captions(spark, html, caption):
    assert PG.page_fields(_pages(spark, html)).first().caption == caption


def test_link_forms(spark):
    html = ('<a data-href="/video/9" href="/video/1">x</a><a href=\'/video/2\'>y</a><!-- <a href="/video/3">z</a> -->'
            '<a href="x/video/4">r</a><a href="../video/5">u</a><script>"<a href=\'/video/6\'>"</script>')
    got = PG.page_links(_pages(spark, html, "https://h.example/a/b")).orderBy("pos").collect()
    assert [r.link for r in got] == ["https://h.example/video/1", "https://h.example/video/2",
                                     "https://h.example/a/x/video/4", "https://h.example/video/5"]
    bare = PG.page_links(_pages(spark, '<a href="x/video/1">x</a>', "https://h.example")).first()
    assert bare.link == "https://h.example/x/video/1"


def test_hot_hashtag_sample_matches_brute_force(spark):
    """One hashtag holds most pages; links repeat inside and across pages.
    First-N per hashtag in (page, position) order, the same on any
    partitioning, with the partial limit in the plan."""
    rows = []
    for pid in range(60):
        tag = "hot" if pid % 10 else f"cold{pid}"
        links = [(pid * 7 + k) % 23 for k in range(5)] + [pid % 4]
        html = "".join(f'<a href="/video/{v}">v</a>' for v in links)
        rows.append((pid, f"https://www.site.example/tag/{tag}", html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for pid, url, html in sorted(rows):
        tag = url.rsplit("/", 1)[1]
        seen = want.setdefault(tag, [])
        for v in [int(x) for x in html.replace('<a href="/video/', " ").replace('">v</a>', " ").split()]:
            link = f"https://www.site.example/video/{v}"
            if link not in seen:
                seen.append(link)
    want = {t: ls[:3] for t, ls in want.items()}
    for df in (pages, pages.repartition(7)):
        out = PG.hashtag_sample(df)
        got = {}
        for r in out.orderBy("hashtag", "rank").collect():
            got.setdefault(r.hashtag, []).append(r.link)
        assert got == want
    assert "WindowGroupLimit" in PG.hashtag_sample(pages)._jdf.queryExecution().executedPlan().toString()


def test_a_page_that_cannot_be_read_costs_itself_only(spark):
    from pyspark.sql import functions as F

    from riskspark.sources import pages as PG

    good = "<h1>Title</h1><a href='/video/1'>x</a>"
    df = spark.createDataFrame([(1, "http://h.example/", good), (2, "http://h.example/", "bad"), (3, None, None)],
                               "page_id long, url string, html string")
    df = df.withColumn("html", F.when(F.col("page_id") == 2, F.unhex(F.lit("3C703EFFFE")).cast("string")).otherwise(F.col("html")))
    fields = {r["page_id"]: r["caption"] for r in PG.page_fields(df, (("h1", None, None),)).collect()}
    assert fields == {1: "Title", 3: ""}
    assert [r["link"] for r in PG.page_links(df).collect()] == ["http://h.example/video/1"]
    failed = PG.page_failures(df).collect()
    assert {tuple(r) for r in PG.page_status(df).collect()} == {("h.example", 2, 1), (None, 1, 0)}
    assert [r["page_id"] for r in failed] == [2] and failed[0]["error"].startswith("UnicodeDecodeError")


def test_unmatched_end_tags_are_linear():
    import time

    from riskspark.sources.pages import _Page

    began = time.time()
    p = _Page([("p", None, None)])
    p.feed("<div>" * 20_000 + "</b>x" * 100_000 + "<p>kept</p></div><p>later")
    p.close()
    assert ["".join(t) for t in p.texts[0]] == ["kept", "later"] and time.time() - began < 20
