"""The top-k join of label sets against all pairs of rows."""

import numpy as np
import pytest
from test_ranking import frame

from rankweave.operators import spectral, weights


def slow_edges(y, sim, k):
    both, c = (y @ y.T).astype(float), y.sum(1).astype(float)
    below = {"jaccard": c[:, None] + c - both, "cosine": np.sqrt(np.outer(c, c)), "hamming": np.full(both.shape, y.shape[1])}[sim]
    a = np.where(below > 0, (both if sim != "hamming" else both + (1 - y) @ (1 - y).T) / np.maximum(below, 1e-10), 0)
    np.fill_diagonal(a, 0)
    out = {}
    for i in range(len(y)):
        for j in sorted((j for j in range(len(y)) if j != i and a[i, j] > 0), key=lambda j: (-round(a[i, j], 12), j))[:k]:
            out[i, j] = out[j, i] = a[i, j]
    return out


def rows_of(spark, y):
    return frame(spark, np.zeros((len(y), 1)), y)


@pytest.mark.parametrize("sim", ["jaccard", "cosine", "hamming"])
@pytest.mark.parametrize("k", [1, 4])
def test_edges_are_those_of_all_pairs(spark, sim, k):
    """A few labels with many ties, rows without labels, and many rows of one pattern."""
    rng = np.random.default_rng(k)
    y = (rng.random((90, 9)) < rng.random(9) * 0.6).astype(int)
    y[:30], y[30:34] = y[40], 0
    got = {(r["p"], r["q"]): r["w"] for r in spectral.knn_edges(rows_of(spark, y), sim, k).collect()}
    want = slow_edges(y, sim, k)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_few_pairs_are_made(spark):
    """Many labels of very different frequencies: pairs made, seeds included, are far below all pairs of patterns."""
    rng = np.random.default_rng(5)
    base = (rng.random((150, 120)) < 0.6 / np.arange(1, 121) ** 0.5).astype(int)
    y = np.repeat(base, 6, 0) ^ (rng.random((900, 120)) < 0.01)
    pats = weights.pattern_counts(rows_of(spark, y))
    pairs, seeds, bounds = spectral.near_patterns(pats, "jaccard", 4)
    n, made = pats.count(), pairs.count() + seeds.count()
    print(f"{n} patterns, {n * n} pairs of patterns, {spectral.pattern_edges(pats).count()} above zero, {made} made, {seeds.count()} of them seeds")
    assert bounds.count() == n and made < 0.2 * n * n
