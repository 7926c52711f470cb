"""N-grams and TF-IDF against brute-force Python definitions."""

import math
import re
from collections import Counter

import pytest

from riskspark.operators import features as FE

TOKEN = re.compile(r"(?u)\b\w\w+\b")


def py_word(text):
    toks = TOKEN.findall(text.lower())
    return toks + [a + " " + b for a, b in zip(toks, toks[1:])]


def py_char_wb(text, lo=3, hi=5):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


DOCS = ["a bb ccc dddd", "Çay éé au-delà straße", "x", "", "the the cat sat on the mat",
        "ab ab ab", "hello_world 42 x2"]


def _corpus(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc long, text string")


@pytest.mark.parametrize("kind,fn", [("word", py_word), ("char", py_char_wb)])
def test_term_counts_match_definition(spark, kind, fn):
    got = {(r.doc, r.term): r.tf for r in FE.term_counts(_corpus(spark), "doc", "text", kind).collect()}
    want = {}
    for i, t in enumerate(DOCS):
        for term, c in Counter(fn(t)).items():
            want[(i, term)] = c
    assert got == want


def test_tfidf_matches_definition(spark):
    spec = FE.TfidfSpec("word", max_features=5, min_df=1, max_df=1.0, sublinear=True)
    w, vocab = FE.tfidf(_corpus(spark), "doc", "text", spec)
    n = len(DOCS)
    counts = [Counter(py_word(t)) for t in DOCS]
    df = Counter(term for c in counts for term in c)
    total = Counter()
    for c in counts:
        total.update(c)
    keep = sorted(total, key=lambda t: (-total[t], t))[:5]
    assert sorted(r.term for r in vocab.collect()) == sorted(keep)
    want = {}
    for i, c in enumerate(counts):
        ws = {t: (1 + math.log(c[t])) * (math.log((1 + n) / (1 + df[t])) + 1) for t in c if t in keep}
        norm = math.sqrt(sum(v * v for v in ws.values()))
        for t, v in ws.items():
            want[(i, t)] = v / norm
    got = {(r.doc, r.term): r.weight for r in w.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_min_max_df_pruning(spark):
    spec = FE.TfidfSpec("word", max_features=None, min_df=2, max_df=0.3)
    c = _corpus(spark)
    vocab = FE.vocabulary(FE.term_counts(c, "doc", "text", "word"), len(DOCS), spec, "doc")
    counts = [set(py_word(t)) for t in DOCS]
    df = Counter(t for s in counts for t in s)
    want = {t for t, v in df.items() if 2 <= v <= 0.3 * len(DOCS)}
    assert {r.term for r in vocab.collect()} == want


def test_vocab_broadcast_and_no_shuffle_of_terms(spark):
    w, _ = FE.tfidf(_corpus(spark), "doc", "text", FE.TfidfSpec("word", max_features=3))
    w.collect()
    plan = w._jdf.queryExecution().executedPlan().toString()  # the final adaptive plan
    assert "BroadcastHashJoin" in plan
    # the only shuffles: corpus by doc (x2: counts for the vocabulary and for
    # the weights), and document frequency by term -- none by (doc, term)
    assert "hashpartitioning(doc, term" not in plan


def test_top_terms_match_the_ordered_limit(spark):
    """Many ties at the cut: the histogram keeps exactly the rows of
    orderBy(total desc, term).limit(k)."""
    rows = [(f"t{i:03d}", 1 + (i * 7) % 5) for i in range(300)]
    stats = spark.createDataFrame(rows, "term string, total long").repartition(6)
    for k in (1, 37, 120, 299, 300, 400):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        got = [tuple(r) for r in FE.top_terms(stats, k, max_funnel_rows=0).collect()]
        assert sorted(got, key=lambda r: (-r[1], r[0])) == want


def test_first_trainer_uses_single_words(spark):
    df = spark.createDataFrame([(1, "Aa bb aa"), (2, "bb cc x")], "doc long, text string")
    w, _ = FE.tfidf(df, "doc", "text", FE.V1_WORD)
    got = {(r.doc, r.term): r.weight for r in w.collect()}
    both, one = 1.0, math.log(3 / 2) + 1
    n1, n2 = math.hypot(2 * one, both), math.hypot(both, one)
    assert got == pytest.approx({(1, "aa"): 2 * one / n1, (1, "bb"): both / n1, (2, "bb"): both / n2, (2, "cc"): one / n2})


def test_oov_summary_reads_the_texts_twice(spark):
    """One pass fills the written term table (vocabulary and unknown terms), one counts known terms by document."""
    rows = [(1, "aa bb aa", True), (2, "bb cc x", False), (3, "dd", False), (4, "aa bb", True)]
    df = spark.createDataFrame(rows, "doc long, text string, mine boolean")
    stats = FE.oov_stats(FE.term_counts(df, "doc", "text", "word", max_words=1, keep=("mine",)), "mine")
    assert {tuple(r) for r in stats.collect()} == {("aa", 2, 3), ("bb", 2, 2), ("cc", 0, 0), ("dd", 0, 0)}
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan     # read back, not computed again
    vocab = FE.vocabulary_of(stats, 2, FE.TfidfSpec(min_df=1))
    assert {r.term for r in vocab.collect()} == {"aa", "bb"}


def test_terms_are_summed_up_in_their_document(spark, monkeypatch):
    """No term is a row before a document is summed up or weighed; rows of one
    document count together, also where its terms take several rows."""
    rows = [(1, "ab ab xyz"), (1, "ab abcd"), (None, "abc"), (None, "xyz"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc long, text string")
    want = {}
    for doc, text in rows:
        want.setdefault(doc, Counter()).update(py_char_wb(text or ""))
    monkeypatch.setattr(FE, "LIST_TERMS", 4)
    lists = FE.term_lists(df, "doc", "text", "char")
    out = FE.term_summary(lists, "doc")
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {
        d: (sum(c.values()), len(c), min(c), max(c)) for d, c in want.items() if c}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_weights_alike_by_broadcast_and_by_shuffle(spark):
    spec = FE.TfidfSpec("char", max_features=40, sublinear=True)
    c = spark.createDataFrame([*enumerate(DOCS), (0, "the bb"), (None, "dddd a")], "doc long, text string")
    w, vocab = FE.tfidf(c, "doc", "text", spec)
    joined = FE.term_weights(c, "doc", "text", spec, vocab, max_bytes=0)
    got, want = ({(r.doc, r.term): r.weight for r in d.collect()} for d in (w, joined))
    assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-12)
    assert "Window" not in w._jdf.queryExecution().executedPlan().toString()


def test_char_counts_by_numbers_and_one_by_one():
    """Texts of few characters are counted as numbers, others one by one; both follow the definition."""
    for text in [*DOCS, "a", "aaaa aaa", "  x\u2003yé\x85z ", "日本 語語語語語語 🙂🙂🙂 a", "nul\0 a\0"]:
        want = Counter(py_char_wb(text))
        for alphabet in (1 << 12, 1):
            got = Counter()
            FE._count_chars(got, text.lower(), alphabet)
            FE._count_chars(got, "", alphabet)
            assert got == want


def test_counts_of_many_documents_are_those_of_each():
    """All n-grams of several documents by one sort; by halves, or one by one, where the characters are too many."""
    wide = "".join(chr(0x4e00 + i) + " ab "[i % 4] for i in range(6000))
    for docs in ([[d] for d in DOCS if d] + [["a b", "", "b a"], []], [["ab ab"], [wide], ["nul\0 a\0", "x"], ["ab"]], [["", "  "]]):
        for got, one in ((FE.gram_counts(docs), FE._count_chars), (FE.word_counts(docs, 2), lambda c, t: FE._count_words(c, t, 2))):
            terms, doc, number, tf = got
            for k, texts in enumerate(docs):
                want = Counter()
                for t in texts:
                    one(want, t)
                mine = doc == k
                assert {terms[i]: n for i, n in zip(number[mine].tolist(), tf[mine].tolist())} == want
            assert (doc[1:] >= doc[:-1]).all()


def test_weights_of_many_documents_are_those_of_each():
    docs = [["a b a c"], ["x"], ["c c c"], []]
    known = {"a": (4, 1.5), "c": (2, 0.5), "a b": (9, 2.0)}
    for sublinear in (True, False):
        counts = FE.word_counts(docs)
        doc, number, weight = FE.known_weights(counts, known, sublinear)
        for k, texts in enumerate(docs):
            one = Counter()
            for t in texts:
                FE._count_words(one, t, 2)
            mine = doc == k
            assert dict(zip(number[mine].tolist(), weight[mine].tolist())) == pytest.approx(FE._weigh(one, known, sublinear))


def test_totals_are_the_statistics_of_the_counts(spark, monkeypatch):
    """Terms are summed up before they are rows; a document of many texts is counted once."""
    data = [*enumerate(DOCS), (0, "the bb"), *[(None, f"dddd a{i % 3}") for i in range(9)], (77, "the"), (77, None)]
    c = spark.createDataFrame(data, "doc long, text string")
    for chars, texts in ((1 << 20, 1 << 8), (30, 4)):
        monkeypatch.setattr(FE, "LIST_CHARS", chars)
        monkeypatch.setattr(FE, "LIST_ROWS", texts)
        for kind in ("word", "char"):
            got, want = ({r.term: (r.df, r.total) for r in d.collect()} for d in (
                FE.term_totals(c, "doc", "text", kind), FE.term_stats(FE.term_counts(c, "doc", "text", kind))))
            mine: dict = {}
            for doc, text in data:
                mine.setdefault(doc, Counter()).update((py_word if kind == "word" else py_char_wb)(text or ""))
            assert got == want == {t: (sum(t in d for d in mine.values()), sum(d[t] for d in mine.values()))
                                   for t in set().union(*mine.values())}
