"""The Jaccard join's signatures and the rows that carry its links."""

import numpy as np
import pyarrow as pa
import pytest

from riskspark.llm import jaccard as J
from tests.llm.test_operators import collected, jaccard_components

COLS = ("doc_id", "n_shingles", "component_id")


def sets_to_arrays(sets):
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


@pytest.mark.parametrize("n", [*range(1, 40), 57, 58, 60, 87, 88, 131, 132, 200, 333, 437, 438, 1000, 3000])
def test_every_similar_pair_shares_slack_signatures(n):
    rng = np.random.default_rng(n)
    pairs = []
    for m in sorted({n, min(n + 1, n * 5 // 4), (n + n * 5 // 4) // 2, n * 5 // 4}):
        for _ in range(6):
            f = rng.integers(0, 2**63, 4 * m + 8)
            common = -(-4 * (n + m) // 9)       # as few as a similarity of 0.8 allows
            if common > n:
                continue
            pairs.append((f[:n], np.concatenate([f[:common], f[2 * m:2 * m + m - common]])))
    for a, b in pairs:
        sig, text, slack = J.signatures(*sets_to_arrays([a, b]))
        mine, yours = set(sig[text == 0]), set(sig[text == 1])
        both = len(mine & yours)
        assert both >= 1
        # the slack of either set in the window that both are in
        assert both >= max(min(slack[text == 0]), min(slack[text == 1]))


def test_links_through_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join([f"x{j}" for j in range(k)] + w[k:])
    rows = [(1, text(0)), (None, text(3)), (2, text(6)), (None, text(9)), (None, text(9)),
            (5, "a " * 3 + " ".join(f"q{i}" for i in range(50))), (5, " ".join(f"r{i}" for i in range(50))),
            (6, " ".join(f"r{i}" for i in range(49))), (5, " ".join(f"r{i}" for i in range(50))), (7, text(40))]
    got = collected(J.join(spark.createDataFrame(rows, "doc_id long, text string")), *COLS)
    assert got == jaccard_components(rows)
    assert {c for i, _, c in got if i in (1, 2)} == {1}


def test_two_large_groups_sharing_a_passage(spark, monkeypatch):
    """Groups of near copies around a common passage: hot signatures hold several components."""
    monkeypatch.setattr(J, "HOT", 5)
    monkeypatch.setattr(J, "PIVOTS", 2)
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for g in range(5):
        own = [f"g{g}x{i}" for i in range(60)]
        for k in range(25):
            mine = list(own)
            mine[int(rng.integers(0, 60))] = f"e{k}"
            rows.append((100 * g + k, " ".join(passage + mine)))
    got = collected(J.join(spark.createDataFrame(rows, "doc_id long, text string")), *COLS)
    assert got == jaccard_components(rows)


def test_signatures_of_a_partition_travel_in_one_row():
    texts = [" ".join(f"w{k}x{i}" for i in range(40 + 90 * k)) for k in range(6)] + ["one two", "", None, "one two"]
    column, parts = pa.array(texts), 5
    got = list(J._signatures(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), parts))
    rows = [r for b in got for r in b.to_pylist()]
    ((_, f, at),) = J._sets_of(column)
    node, n, (sig, text, slack) = J.nodes(f, at), np.diff(at), J.signatures(f, at)
    want = {(int(s), int(node[t]), int(n[t]), int(k)) for s, t, k in zip(sig, text, slack)}
    assert sorted((s, r["node"], r["n"], r["slack"]) for r in rows for s in r["sigs"]) == sorted(want)
    assert all(s % parts == r["part"] for r in rows for s in r["sigs"])
    keys = [(r["part"], r["node"], r["slack"]) for r in rows]
    assert len(set(keys)) == len(keys) < len(want) / 2
