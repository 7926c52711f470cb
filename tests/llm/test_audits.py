"""Host rules, filter audit and periodic runs against brute-force versions, plus the odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import filteraudit as A
from riskspark.llm import hostrules as R
from riskspark.llm import periodicruns as P
from riskspark.llm import queries as Q
from tests.conftest import SF001
from tests.llm.test_operators import SCHEMA, odd_rows, table_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string, good string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    rows += [(40, "a b\na b\n\n \na b\nc", "en", "", 1, "", "", ""), (41, "# $ | < > * & %", "en", "src", 1, "", "", ""),
             (42, "GO " * 300, "en", "src", 1, "", "", ""), (43, "go\x0bgo\tgo\x85go\xa0go " * 20, "en", "src", 1, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- host rules -------------------------------------------------------------

def measures(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


def measured(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed) for r in df.collect())


def expected_measures(rows):
    out = []
    for doc_id, text in rows:
        m = measures(text)
        out.append((str(doc_id), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    return sorted(out)


def test_measures_equal_brute_force(spark, odd):
    docs = table_of("documents")
    assert measured(Q.op11_host_rules(spark, SF001)) == expected_measures(zip(docs.doc_id, docs.text))
    assert measured(R.judge(odd)) == expected_measures((r.doc_id, r.text) for r in odd.collect())


def test_shrunk_rates_and_verdicts(spark):
    good, bad = "plain words about many different things " + " ".join(f"w{i}" for i in range(60)), "too short"
    hosts = {"clean": (200, 0), "mixed": (150, 50), "spam": (4, 400), "one_bad": (0, 1), None: (90, 10)}
    rows = [(i, h, t) for h, (a, b) in hosts.items() for i, t in enumerate([good] * a + [bad] * b)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    per = {r.host: r for r in R.host_verdicts(R.measures(df)).collect()}
    # the same prior by hand
    n = [a + b for a, b in hosts.values()]
    f = [b for _, b in hosts.values()]
    docs, failed = sum(n), sum(f)
    parts = sum(Fraction(y * y, x) for x, y in zip(n, f))
    between = (parts - Fraction(failed * failed, docs)) / (len(n) - 1)
    within = (failed - parts) / (docs - len(n))
    size = (docs - Fraction(sum(x * x for x in n), docs)) / (len(n) - 1)
    rho = round(float((between - within) / (between + (size - 1) * within)), 6)
    weight = (1 - rho) / rho
    for h, (a, b) in hosts.items():
        assert per[h].rate_short == pytest.approx((b + failed / docs * weight) / (a + b + weight), abs=2e-6)
    assert {h for h, r in per.items() if r.host_rejected} == {"spam", "one_bad"} - ({"one_bad"} if per["one_bad"].rate_short < 0.5 else set())
    assert per["one_bad"].rate_short < 1.0      # one document is not believed alone
    out = R.judge(df)
    assert out.where("NOT kept AND NOT base_failed").count() == 4       # clean documents of the rejected host
    assert out.where("kept").count() == 200 + 150 + 90


def test_one_host_and_equal_hosts_get_the_common_rate(spark):
    for hosts in (["a"], ["a", "b", "c"]):
        rows = [(i, h, "x y z " if i % 4 else " ".join(f"w{j}" for j in range(80))) for h in hosts for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        assert {r.rate_short for r in R.host_verdicts(R.measures(df)).collect()} == {0.75}


# -- filter audit -----------------------------------------------------------

def audit_by_hand(rows, labels):
    """Applies all 120 orders to every document."""
    rows = [(i, s or "", t or "") for i, s, t in rows]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    docs = []
    for i, s, t in rows:
        w = WORD.findall(t)
        fails = ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
                 + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
                 + "E" * (i is not None and i > first[t]))
        own = [x for x in labels if i is not None and x[0] == i]
        docs.append((s, fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in mine) - len(gone),
                                          sum(d[1] == f for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                              r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_all_orders_by_hand(spark, odd):
    docs, labels = table_of("documents"), table_of("labels")
    want = audit_by_hand(zip(docs.doc_id, docs.source, docs.text), list(zip(labels.doc_id, labels.quality, labels.toxic)))
    assert audited(Q.op12_filter_audit(spark, SF001)) == want
    marks = [(0, 1, 0), (5, 1, 1), (5, 0, None), (6, None, None), (None, 1, 1), (99, 1, 1), (41, 0, 1)]
    lab = spark.createDataFrame([(*m, "p", "g") for m in marks], LABELS)
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    assert audited(A.audit(odd, lab)) == audit_by_hand(rows, marks)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=32, max_size=32))
def test_least_squares_gives_shapley_values(counts):
    gone = A.removals(counts)
    for f in range(A.N):
        want = Fraction(0)
        for order in itertools.permutations(range(A.N)):
            s = sum(1 << x for x in order[:order.index(f)])
            want += gone[s | 1 << f] - gone[s]
        assert A.shapley(gone)[f] * 120 == want


# -- periodic runs ----------------------------------------------------------

def runs_by_hand(w, least=4, short=6):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(short, least * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 4), st.sampled_from([1, 3, 17, 1 << 15]))
def test_catchers_find_all_runs(seed, least, append):
    rng = random.Random(seed)
    n = rng.randint(0, 150)
    w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 4))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w[rng.randrange(n)] = rng.randrange(3)
    assert P.find_runs(np.array(w, np.int64), least, 6, append) == runs_by_hand(w, least)


def test_many_words_and_long_periods():
    for p in (1, 2, 999, 6000, 24_999):
        w = np.arange(100_000) % p
        assert P.find_runs(w) == [(0, 100_000, p)]
    w = np.concatenate([np.arange(5000), np.arange(20_000) % 3000 + 7000, np.arange(4)])
    assert P.find_runs(w) == [(5000, 20_000, 3000)]
    assert P.find_runs(np.arange(50_000)) == []


def test_state_does_not_grow_with_the_stream():
    c = P.Catchers(max_period=100)
    for i in range(40):
        c.append(np.random.default_rng(i).integers(0, 9, 5000))
    assert max(map(len, c.hashes)) < 3 * 5000


def report_by_hand(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_runs_of_documents_equal_brute_force(spark, odd):
    docs = table_of("documents")
    few = docs[docs.text.str.len() < 6000]
    got = {tuple(r) for r in Q.op13_periodic_runs(spark, SF001).collect()}
    assert len(got) == len(docs)
    assert {report_by_hand(int(i), t) for i, t in zip(few.doc_id, few.text)} <= got
    short = odd.where("doc_id IS NULL OR doc_id NOT IN (8, 9)")     # 6,000 words: too long by hand
    want = sorted(map(repr, (report_by_hand(r.doc_id, r.text) for r in short.collect())))
    assert sorted(repr(tuple(r)) for r in P.runs(short, edit=True).collect()) == want
    assert P.runs(odd, edit=True).count() == odd.count()


def test_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "a b c " + "x y " * 5 + "end"), (2, "GO go " * 4 + "\n\tgo"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.runs(df, with_runs=True, with_text=True).collect()}
    assert got[1].collapsed == "a b c x y end" and [tuple(r) for r in got[1].runs] == [(3, 10, 2)]
    assert got[2].collapsed == "GO go go" and got[2].n_runs == 1
    assert got[3].collapsed == "" and got[3].runs == []
    assert got[3].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


# -- all three --------------------------------------------------------------

def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    assert R.judge(empty).count() == A.audit(empty, labels).count() == P.runs(empty, edit=True).count() == 0


def test_clashing_columns(spark):
    extra = "doc_id long, text string, source string, n_words string, kept string, w string, part string, pattern string, host string, lines string, whole string, good string"
    df = spark.createDataFrame([(i, "one two three " * 30, "s", *"abcdefghi") for i in range(4)], extra)
    labels = spark.createDataFrame([(1, 1, 0, "p", "g")], LABELS)
    assert [r.n_words for r in R.judge(df).collect()] == [90] * 4
    assert A.audit(df, labels).count() == 600
    assert [r.n_runs for r in P.runs(df).collect()] == [1] * 4
