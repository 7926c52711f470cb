"""Every operator against a brute-force version, an exact round trip or
held-out accuracy, plus the odd inputs: nulls, empty tables, repeats,
long texts, clashing column names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from riskspark.llm import queries as Q
from tests.conftest import SF001, SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, score string, node string"


def table_of(name, sf=SF001):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog while seven wizards box quietly near my old house "
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    texts = [None, "", "   \n", "one", "Licensed under the MIT License.", base * 4, base * 4, base * 3 + "entirely new end",
             long, long + " tail", "héé ünï " * 60, "x" * 900, "你好 123"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", 1, "m", "s", "n") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base * 4, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- brute-force versions ---------------------------------------------------

def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    inv, up = collections.defaultdict(set), list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, s) in enumerate(sets):
        for j in {j for h in s for j in inv[h]}:
            both = len(s & sets[j][1])
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                up[find(k)] = find(j)
        for h in s:
            inv[h].add(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k), i)) for k, (i, s) in enumerate(sets)), key=str)


def suffix_rows(rows, n=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k:k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if seen[b[k:k + n]] > 1:
                gone[k] += 1
                gone[k + n] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if len(b) else np.zeros(0, bool)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by",
           ("mit", "license"): "mit"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((i, lab) for i in range(len(w)) for p, lab in PHRASES.items() if tuple(w[i:i + len(p)]) == p)
    return (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))


# -- queries on the driver's tables -------------------------------------------

def test_jaccard_join(spark, odd, empty):
    from riskspark.llm import jaccard as J

    cols = ("doc_id", "n_shingles", "component_id")
    docs = table_of("documents", SF01)
    assert collected(Q.op1_jaccard_join(spark, SF01), *cols) == jaccard_components(list(zip(docs.doc_id, docs.text)))
    assert collected(J.join(odd), *cols) == jaccard_components([r[:2] for r in odd_rows()])
    assert J.join(empty).count() == 0


def test_jaccard_hot_signatures(spark, monkeypatch):
    """Many texts sharing passages, a chain of near copies and copies, with a low bound on hot signatures."""
    from riskspark.llm import jaccard as J

    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows, last = [], [f"c{i}" for i in range(120)]
    for i in range(60):
        own = " ".join(f"u{x}" for x in rng.integers(0, 10**6, 20))
        rows.append((i, f"{passage} {own}"))
    for i in range(60, 110):
        last = list(last)
        last[int(rng.integers(0, 120))] = f"e{i}"
        rows.append((i, " ".join(last)))
    rows += [(200 + i, rows[70][1]) for i in range(30)]
    monkeypatch.setattr(J, "HOT", 6)
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got, "doc_id", "n_shingles", "component_id") == jaccard_components(rows)


def test_toxicity(spark, odd, empty):
    from riskspark.llm import toxicity as X

    got = Q.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(table_of("labels", "/root/testdata/sf0.1"), on="doc_id")
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert (got.held_out == got.doc_id.isin(held.doc_id)).all()
    hit = held.predicted == 1
    assert held.toxic[hit].mean() > 0.9 and hit[held.toxic == 1].mean() > 0.85
    model = X.train(odd, spark.createDataFrame([(5, 1, 1), (6, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int"))
    scored = X.score(odd, model)
    assert scored.count() == len(odd_rows()) and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert X.score(empty, model).count() == 0
    assert X.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).trained is False


def test_embeddings(spark):
    from riskspark.llm import embeddings as V

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base + 0.01 * rng.normal(size=base.shape) for _ in range(4)] + [base[:1].repeat(1100, 0) + 0.02 * rng.normal(size=(1100, 64))])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None] * 64, 0), (n + 4, [1.0, 2.0], 0), (n + 5, [], 0)]
    got = V.near_duplicates(spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<float>, label int")).toPandas()
    assert len(got) == n + 7 and (got[got.vec_id >= n].n_links == 0).all()
    x = x.astype(np.float32).astype(np.float64)
    u = np.sqrt((x * x).sum(1))
    link = x @ x.T >= 0.95 * np.outer(u, u)
    np.fill_diagonal(link, False)
    one = got[got.vec_id < n].drop_duplicates().sort_values("vec_id")
    assert one.n_links.sum() >= 0.99 * link.sum() and (one.n_links.to_numpy() <= link.sum(1)).all()
    assert (one.component_id.to_numpy() == [i % 60 if i < 240 else 0 for i in range(n)]).all()
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language(spark, odd, empty):
    from riskspark.llm import langid as L

    got = Q.op4_language(spark, SF01).toPandas().merge(table_of("documents", SF01)[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    model = L.train(spark.read.parquet(f"{SF001}/documents.parquet"))
    res = {r["doc_id"]: r for r in L.identify(odd, model, spans=True).collect()}
    assert all(res[i]["lang_pred"] == "und" and res[i]["score"] == 0 for i in (0, 1, 2))
    assert L.identify(empty, model).count() == 0
    none = L.identify(odd, L.train(empty))
    assert none.where("lang_pred <> 'und'").count() == 0
    docs = table_of("documents", SF01)
    mixed = " ".join(docs[docs.lang == x].text.iloc[3] for x in ("en", "de"))
    spans = L.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).first()["spans"]
    assert {s["lang"] for s in spans} >= {"en", "de"}


def test_mixing(spark, odd, empty):
    from riskspark.llm import mixing as M

    rows = collected(Q.op5_source_mix(spark, SF01), "doc_id", "size", "source_size", "target", "taken")
    docs = table_of("documents", SF01).set_index("doc_id").sort_index()
    got = pd.DataFrame(rows, columns=["doc_id", "size", "source_size", "target", "taken"]).set_index("doc_id").sort_index()
    assert (got["size"] == docs.text.map(lambda t: len(WORD.findall(t)))).all()
    assert (got.taken <= 2 * got["size"]).all()
    per = got.groupby(docs.source).agg(target=("target", "first"), n=("source_size", "first"), taken=("taken", "sum"))
    assert abs(per.target.sum() - 1.5 * per.n.sum()) < 1e-6 * per.n.sum() and (per.target <= 2 * per.n + 1e-9).all()
    assert abs(per.taken.sum() / per.target.sum() - 1) < 0.05
    assert rows == collected(Q.op5_source_mix(spark, SF01), "doc_id", "size", "source_size", "target", "taken")
    assert M.plan(odd).count() == len(odd_rows()) and M.mix(empty).count() == 0
    assert M.mix(odd).columns == odd.columns


def test_page_text(spark):
    from riskspark.llm import pagetext as H

    pages = table_of("pages")
    want = {}
    for i, h in zip(pages.page_id, pages.html):
        body = re.search(r"<article>(.*?)(?:</article>|$)", h, re.S)[1]
        import html as _h
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want[i] = "\n\n".join(x for x in (" ".join(_h.unescape(p).split()) for p in parts) if x)
    got = {r["page_id"]: r["text"] for r in Q.op6_page_text(spark, SF001).collect()}
    assert got == want
    cases = {
        "<article><p>a &amp; b<p>c<br>d<div class='comments'>x</div></article><footer>f</footer>": "a & b\n\nc d",
        "<body><nav>m</nav><p>only <b>text</b></p><script>if (a<b) '</p>'</script></body>": "only text",
        "<main><h1>T</h1><aside>s</aside><ul><li>x<li>y</ul>": "T\n\nx\n\ny", "": "", "plain < text": "plain < text",
        "<article><p title='a>b'>q</p><!-- <p>no</p> --><form>f</form></article>": "q"}
    for page, text in cases.items():
        assert H.main_text(page) == text
    site = [(k, "http://h.example/1", f"<body><div>Shop menu</div><p>story {k} words</p></body>") for k in range(10)]
    site += [(50, None, None), (51, "", ""), (0, *site[0][1:])]
    out = H.extract(spark.createDataFrame(site, "page_id long, url string, html string")).collect()
    assert len(out) == 13 and all(r["text"] == f"story {r['page_id']} words" for r in out if r["page_id"] < 50)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_without_own_ids(spark):
    """Rows without an id, or sharing one, draw each for itself, copies of one text too."""
    from riskspark.llm import mixing as M

    rows = ([(None, "ten words " * 5, "a")] * 3000 + [(7, f"text {i} of one id", "b") for i in range(3000)]
            + [(i + 10, "four words of text", "c") for i in range(3000)])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    per = M.plan(df, with_columns=True).groupBy("row.source").agg({"target": "max", "size": "sum"}).collect()
    assert len(per) == 3
    taken = {r[0]: (r[1], r[2]) for r in M.plan(df, with_columns=True).selectExpr(
        "row.source AS s", "size * copies AS t", "target").groupBy("s").agg({"t": "sum", "target": "max"}).select(
        "s", "sum(t)", "max(target)").collect()}
    for t, target in taken.values():
        assert t == pytest.approx(target, rel=0.06)
    assert M.mix(df).count() == M.plan(df).selectExpr("sum(copies)").first()[0]


def test_licenses(spark, odd, empty):
    from riskspark.llm import licenses as S

    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    docs = table_of("documents", SF01)
    got = Q.op7_licenses(spark, SF01)
    assert collected(got, *cols) == sorted(((i, *license_base(t)) for i, t in zip(docs.doc_id, docs.text)), key=str)
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where("base_labels <> '' AND NOT arrays_overlap(split(base_labels, ','), split(labels, ','))").count() == 0
    extra = [(1, "cc by cc by MIT\nLicense mit license", None), (1, "cc by cc by MIT\nLicense mit license", None), (None, "apache license", None)]
    df = spark.createDataFrame(extra, "doc_id long, text string, score string")
    assert collected(S.scan(df), *cols) == sorted(((i, *license_base(t)) for i, t, _ in extra), key=str)
    assert collected(S.scan(odd), *cols) == sorted(((r[0], *license_base(r[1])) for r in odd_rows()), key=str)
    assert S.scan(empty).count() == 0


def test_fingerprints(spark, odd, empty):
    from riskspark.llm import fingerprints as B

    docs = table_of("documents").sort_values("doc_id").reset_index(drop=True)
    got = {r["doc_id"]: r for r in Q.op8_fingerprints(spark, SF001).collect()}

    def parts(t):
        """Walks the text: a paragraph begins at a character that is no space and ends by the stated rule."""
        out, start = set(), None
        for k, c in enumerate(t):
            if start is None and c not in " \t\n\x0b\f\r":
                start = k
            after = t[k + 1:k + 2]
            stop = start is not None and k > 0 and t[k - 1] in "aeiou" and c in ".!?" and after in set(" \t\n\x0b\f\r")
            if start is not None and (stop or after in ("", "\n") or k - start == 95):
                out.add(t[start:k + 1])
                start = None
        return out

    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(zip(docs.doc_id, docs.text)):
        nxt = docs.text[(k + 1) % len(docs)]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(edited)))
        assert r["near_next"] == pytest.approx(like(parts(t), parts(nxt)))
        assert r["near_edited"] > 0 or len(t) < 192 or len(t[:96].strip()) < 96
    one_line = [(1, "盛世长安月色明" * 60), (2, " ".join(f"w{i}" for i in range(4000))), (3, "Ночь улица фонарь " * 40), (4, "x" * 5000)]
    for r in B.report(spark.createDataFrame(one_line, "doc_id long, text string")).collect():
        t, nxt = (one_line[k % 4][1] for k in (r["doc_id"] - 1, r["doc_id"]))
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(edited))) and r["near_edited"] > 0 and r["near_next"] == 0
    by_text = collections.defaultdict(set)
    for i, t in zip(docs.doc_id, docs.text):
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert B.report(odd).count() == len(odd_rows()) and B.report(empty).count() == 0


def test_bpe(spark, odd, empty):
    import public_tokenizers as P
    import tiktoken

    from riskspark.llm import bpe

    path = P.path(Q.VOCABULARY)
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table_of("documents")
    got = {r["doc_id"]: r for r in Q.op9_byte_bpe(spark, SF001).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    out = bpe.tokenize(odd, path, P.PATTERN, with_text=True).collect()
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in out) == collections.Counter((r[0], r[1] or "") for r in odd_rows())
    assert bpe.tokenize(empty, path, P.PATTERN).count() == 0


def test_suffix_dedup(spark, odd, empty):
    from riskspark.llm import suffixdedup as D

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs = table_of("documents", SF01)
    assert collected(Q.op10_suffix_dedup(spark, SF01), *cols) == suffix_rows(list(zip(docs.doc_id, docs.text)))
    assert collected(D.removal_report(odd), *cols) == suffix_rows([r[:2] for r in odd_rows()])
    assert D.removal_report(empty).count() == 0
    assert D.deduplicated(odd).columns == odd.columns and D.deduplicated(odd).count() == len(odd_rows())


def test_induced_sort_against_brute_force():
    from riskspark.llm.inducedsort import repeated_starts

    rng = np.random.default_rng(3)
    for _ in range(300):
        depth, kinds = int(rng.choice([1, 2, 5, 20])), int(rng.choice([1, 2, 4, 200]))
        base = bytes(rng.integers(0, kinds, 90).astype(np.uint8))
        pieces = [base[int(rng.integers(0, 80)):] + bytes(rng.integers(0, kinds, int(rng.integers(0, 30))).astype(np.uint8)) for _ in range(4)]
        seen = collections.Counter(p[i:i + depth] for p in pieces for i in range(len(p) - depth + 1))
        want = [[i for i in range(len(p) - depth + 1) if seen[p[i:i + depth]] > 1] for p in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, depth, int(rng.choice([64, 1 << 20])))] == want


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = C.run(spark, SF01)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and got.count() > 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "byte_bpe"]
    rows = docs.select("doc_id", "text").collect()
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, SF01).collect()}
    assert kept == {i for i, n, c in jaccard_components([tuple(r) for r in rows]) if n == 0 or i == c}
    assert C.remove_repeats(spark, docs, SF01).columns == docs.columns
    assert C.mix_sources(spark, docs, SF01).columns == docs.columns


def test_near_duplicates_keep_rows_without_their_own_id(spark):
    """Null and repeated ids are no reason to go; only linked texts are."""
    import corpus_pipeline as C

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, None), (None, ""), (7, text(2)), (7, text(3)), (7, text(2)),
            (8, text(1)), (9, text(1) + " more"), (None, text(4)), (None, text(4)), (None, ""), (10, text(3)), (6, text(5)), (6, text(5) + " end")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = C.drop_near_duplicates(spark, docs, SF001)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    near = [r for r in got if r[0] == 6]
    assert len(near) == 1 and near[0][1].startswith(text(5))
    assert [r for r in got if r[0] != 6] == sorted([(None, text(0)), (None, None), (None, ""), (None, ""), (7, text(2)), (7, text(3)),
                                                    (8, text(1)), (None, text(4))], key=str)
    assert out.columns == docs.columns


def test_repeats_keep_rows_that_had_no_text(spark):
    """Only documents emptied by the removal go."""
    import corpus_pipeline as C

    copy, own = "some passage here " * 20, " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  "), (4, copy), (5, copy), (6, own), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = C.remove_repeats(spark, docs, SF001)
    assert collected(out, "doc_id", "text") == sorted([r for r in rows if r[1] != copy], key=str)
    assert out.columns == docs.columns


def test_page_furniture_around_and_in_articles():
    """Wrappers named like furniture, text in articles named like it, and comments that are articles."""
    from riskspark.llm import pagetext as H

    page = "<nav>m</nav><article><h1>T</h1><p>some body text</p></article><footer>f</footer>"
    for wrapper in ("form id=aspnetForm", "div class='layout has-sidebar'", "div class='no-sidebar'", "div class='social-post'",
                    "div class='modal'", "section id=comments"):
        assert H.main_text(f"<body><{wrapper}>{page}</{wrapper.split()[0]}></body>") == "T\n\nsome body text"
    assert H.main_text("<form><div class=modal><main><p>body text</p></main><div class=related><article>card</article></div></div></form>") \
        == "body text"
    assert H.main_text("<body><form id=aspnetForm><div>menu</div><p>whole text of the page</p></form></body>") \
        == "menu\n\nwhole text of the page"
    inside = "<h2 id='related-work'>R</h2><p class='notice'>n</p><section id='comments-on-method'>c</section>"
    assert H.main_text(f"<article>{inside}</article>") == "R\n\nn\n\nc"
    comment = "<article class='comment'>reader</article>"
    assert H.main_text(f"<article><p>b</p>{comment}</article>{comment}") == "b"
    assert H.main_text(f"<body>{comment}</body>") == "reader"
    assert H.main_text("<article><p>b</p></article><div class='related'><article>a much longer card of another story</article></div>") == "b"
    for box in ("ad", "ads-box", "cookie-banner", "social-share", "comment-list", "related-posts", "left-sidebar", "x sidebar"):
        assert H.main_text(f"<article><p>b</p><div class='{box}'>x</div></article>") == "b"


def test_page_templates_in_articles_and_text_outside(spark):
    """Boxes that recur inside articles go; headings, list items and words that recur in real text stay; an article
    is a hint only; a menu on some pages of a large host goes by its number."""
    from riskspark.llm import pagetext as H

    schema = "page_id long, url string, html string"
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    box = "<div>Buy our coffee <a href='/shop'>now</a></div>"
    body = "<h2>Notes</h2><p>own {0} <a href=/x>France</a> end</p><ul><li>yes</li><li>{0}</li></ul>"
    rows = [(k, "http://a.example/", f"<body><article>{body.format(word(k))}{box}</article></body>") for k in range(8)]
    rows += [(100 + k, "http://b.example/", f"<article><p>card {k}</p></article><p>{word(k)}</p><p>short {k}</p>") for k in range(4)]
    menu = "<div><a href=1>Home</a> <a href=2>News</a></div>"
    rows += [(1000 + k, "http://c.example/", f"<body>{menu if k < 6 else ''}<p>{word(k)}</p></body>") for k in range(90)]
    out = H.extract(spark.createDataFrame(rows, schema), hot_pages=5).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(got) == len(rows)
    for k in range(8):
        assert got[k] == f"Notes\n\nown {word(k)} France end\n\nyes\n\n{word(k)}"
    for k in range(4):
        assert got[100 + k] == f"card {k}\n\n{word(k)}\n\nshort {k}"
    for k in range(90):
        assert got[1000 + k] == word(k)
    story = f"{word(1)} {word(2)} {word(3)}"
    assert H.main_text(f"<h1>Title</h1><p>by me</p><p>{word(3)}</p><article>{story}</article><p><a href=1>{word(4)}</a></p>") \
        == f"Title\n\n{word(3)}\n\n{story}"


def test_suffix_dedup_hot_hashes(spark, monkeypatch):
    """Hashes with much text go to no shard and lose no mark: a passage among different neighbours, copies and periods."""
    from riskspark.llm import suffixdedup as D

    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    own = lambda n: "".join(rng.choice(letters, n))
    passage = own(260)
    rows = [(k, own(220) + passage[k % 7:] + own(220)) for k in range(60)]
    rows += [(100 + k, own(150) + passage[30:130] + own(150)) for k in range(40)]
    rows += [(200, rows[3][1]), (None, rows[4][1]), rows[5], (201, "xy" * 400), (202, "xy" * 150 + own(90)), (203, None)]
    monkeypatch.setattr(D, "HOT_BYTES", 3000)
    cut = []
    hot = D._hot
    monkeypatch.setattr(D, "_hot", lambda picked: cut.append(hot(picked).count()) or hot(picked))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = D.removal_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got, *cols) == suffix_rows(rows) and cut[0] > 0
    monkeypatch.setattr(D, "HOT_BYTES", 0)
    assert collected(D.removal_report(spark.createDataFrame(rows, "doc_id long, text string")), *cols) == suffix_rows(rows)
