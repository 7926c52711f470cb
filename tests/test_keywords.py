"""Dictionary matching by automaton vs brute force, broadcast and dealt."""

import random
import time

import pytest

from riskspark import rules
from riskspark.operators import keywords as K

TEXTS = ["Kill Myself", "depression depression", "standalone skyscraper", "self harm / self-harm",
         "help me, i give up", "", None, "nothing here", "x" * 250 + "depression" + "y" * 600 + "kys", "ÇOK güzel KYS"]


def _brute(text, words):
    t = (text or "").lower()
    return {w for w in (x.lower() for x in words if x) if w in t}


@pytest.mark.parametrize("part_chars", [K.PART_CHARS, 40, 1])
def test_hits_match_brute_force(spark, part_chars):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    words = [*rules.KEYWORDS_V2, "KYS", "", None, "y" * 500, "ÇOK"]     # equal when lower-cased, blank, long
    dic = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {r.id: r.kw_hits for r in K.keyword_hits_join(texts, dic, "id", "text", part_chars=part_chars).collect()}
    assert got == {i: len(_brute(t, words)) for i, t in enumerate(TEXTS)}
    pairs = {tuple(r) for r in K.keyword_matches(texts, dic, "id", "text", part_chars=part_chars).collect()}
    assert pairs == {(i, w) for i, t in enumerate(TEXTS) for w in _brute(t, words)}
    posts = {r.keyword: (r.n_texts, r.first_id) for r in K.keyword_posts(texts, dic, "id", "text", part_chars=part_chars).collect()}
    for w, (n, first) in posts.items():
        at = [i for i, t in enumerate(TEXTS) if w in _brute(t, words)]
        assert (n, first) == (len(at), min(at, default=None))
    assert len(posts) == len({w.lower() for w in words if w})


def test_empty_dictionary(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    dic = spark.createDataFrame([("",), (None,)], "keyword string")
    assert sorted(tuple(r) for r in K.keyword_hits_join(texts, dic, "id", "text").collect()) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("part_chars", [K.PART_CHARS, 5])
def test_repeated_and_null_ids(spark, part_chars):
    texts = spark.createDataFrame([("a", "one two"), ("a", "two three"), (None, "three"), (None, "x"), ("b", "")], "id string, text string")
    dic = spark.createDataFrame([("one",), ("TWO",), ("three",), ("hre",)], "keyword string")
    got = {r.id: r.kw_hits for r in K.keyword_hits_join(texts, dic, "id", "text", part_chars=part_chars).collect()}
    assert got == {"a": 4, None: 2, "b": 0}


def test_many_and_long_entries(spark):
    """200,000 entries and one of 10,000 characters: the work is linear in the texts."""
    rng = random.Random(3)
    words = [f"{rng.randrange(10**9):x}q" for _ in range(200_000)]
    long = "".join(rng.choice("abcdef") for _ in range(10_000))
    rows = [(i, " ".join(rng.sample(words, 5)) if i % 3 else "nothing") for i in range(300)] + [(300, "zz" + long + "zz")]
    texts = spark.createDataFrame(rows, "id long, text string")
    dic = spark.createDataFrame([(w,) for w in [*words, long]], "keyword string")
    t0 = time.time()
    got = {}
    for r in K.keyword_matches(texts, dic, "id", "text").collect():
        got.setdefault(r.id, set()).add(r.keyword)
    assert time.time() - t0 < 60
    assert got[300] >= {long}
    known = set(words)
    for i, t in rows[:300]:
        if i % 3:
            # substrings of each word and across blanks, by brute force over lengths
            want = {t[a:b] for a in range(len(t)) for b in range(a + 1, min(len(t), a + 12) + 1) if t[a:b] in known}
            assert got.get(i, set()) == want


def test_one_pass_without_a_row_per_position(spark):
    texts = spark.createDataFrame([(1, "a b c")], "id long, text string")
    dic = spark.createDataFrame([("a",)], "keyword string")
    plan = K.keyword_matches(texts, dic, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
