"""Signatures left out of the exchange cost no pair of similar sets."""

import numpy as np

from riskspark.llm import jaccard as J


def test_similar_sets_share_what_is_left_of_the_slack():
    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 4, 9, 17, 40, 85, 150, 300, 440, 1000, 5000):
        for _ in range(6):
            a = np.unique(some(n))
            gone = int(rng.integers(0, n // 9 + 1))     # at least 0.8 alike with as many others
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], some(gone)]))
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            sig, text, slack = J.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            both = len(np.intersect1d(sig[text == 0], sig[text == 1]))
            assert both >= 1 and both >= min(slack[text == 0].min(), slack[text == 1].min())
            assert len(np.unique(sig[text == 0])) == (text == 0).sum()
    assert (J.spared(np.arange(-3, 2)) == 0).all()
    left = np.arange(1000) - J.spared(np.arange(1000))
    assert (np.diff(left) >= 0).all() and (np.diff(J.spared(np.arange(1000))) >= 0).all() and left[1:].min() == 1
