"""Pairs of terms neither of which differs between the labels."""

import random

import numpy as np

from tempora.llm import toxicity


def test_a_pair_with_balanced_marginals():
    rng = random.Random(3)
    rows, y = [], []
    for k in range(3000):
        toxic, a = k % 2, (k // 2) % 2
        b = a if toxic else 1 - a
        rows.append(np.array(sorted({rng.randrange(1000, 1400) for _ in range(6)} | ({1} if a else set()) | ({2} if b else set())), dtype=np.int32))
        y.append(float(toxic))
    m = toxicity.fit(rows, np.array(y))
    score = lambda *c: m.raw(np.array(c, dtype=np.int64), np.array([len(c)]))[0]
    assert score(1, 2) > 1 > 0 > max(score(1), score(2))
