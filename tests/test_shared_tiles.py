"""Neighbours by shared tiles against the neighbours of every subset and fold on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ranking import frame

from rankweave.operators import evaluate, knn, shared_tiles

SUBSETS = {"0,1,2": [0, 1, 2], "1,2,5": [1, 2, 5], "4": [4], "0,1,2,3,4,5": [0, 1, 2, 3, 4, 5]}


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("k", [1, 4, 60])
def test_shared_tiles_are_the_neighbours_of_each_group(spark, monkeypatch, block, k):
    """Equal rows, rows of zeros and ties included; more neighbours asked for than there are."""
    monkeypatch.setattr(shared_tiles, "BLOCK", block)
    monkeypatch.setattr(shared_tiles, "STRIP_BYTES", 8 * 7 * 8 * 3)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (50, 7)) / 2
    x[10:16], x[20] = x[3], 0
    df = frame(spark, x, np.zeros((50, 1)))
    dealt = df.join(evaluate.folds(df), "id").select("id", "fold", "features").cache()
    got = {(r["grp"], r["id"], r["rank"]): (r["near"], r["sim"]) for r in shared_tiles.subset_neighbours(dealt, SUBSETS, 3, k).collect()}
    want = {}
    for name, fids in SUBSETS.items():
        rows = dealt.select(F.lit(name).alias("grp"), "id", "fold", F.array(*(F.col("features")[f] for f in fids)).alias("features"))
        for t in range(3):
            for r in knn.knn(rows.drop("fold"), rows.where(F.col("fold") != t).drop("fold"), k).collect() if t == 1 else slow(x, dealt_folds(dealt), fids, t, k):
                want[f"{name}/{t}", r["id"], r["rank"]] = (r["near"], r["sim"])
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-9 for g in want)


def dealt_folds(dealt):
    return {r["id"]: r["fold"] for r in dealt.collect()}


def slow(x, fold, fids, t, k):
    u = x[:, fids] / np.maximum(np.linalg.norm(x[:, fids], axis=1, keepdims=True), 1e-12)
    sims = np.round(u @ u.T, 10)
    for i in range(len(x)):
        best = sorted((j for j in range(len(x)) if j != i and fold[j] != t), key=lambda j: (-sims[i, j], j))[:k]
        yield from ({"id": i, "rank": r + 1, "near": j, "sim": sims[i, j]} for r, j in enumerate(best))


def test_atoms_share_what_subsets_share():
    atoms, of = shared_tiles.atoms_of([[0, 1, 2], [1, 2, 5], [2, 1]])
    assert atoms == [[0], [1, 2], [5]] and of == [[0, 1], [1, 2], [1]]


def test_few_best_are_those_of_a_whole_sort():
    rng = np.random.default_rng(4)
    sims, ids = rng.integers(0, 4, (30, 17)) / 4, rng.permutation(17)
    sims[rng.random(sims.shape) < 0.2] = -np.inf
    for k in (1, 5, 17, 40):
        row, col = shared_tiles.few_best(sims, ids, k)
        for i in range(30):
            assert col[row == i].tolist() == [c for c in np.lexsort((ids, -sims[i])) if np.isfinite(sims[i, c])][:k]


def test_no_row_and_one_row(spark):
    df = frame(spark, np.ones((1, 3)), np.zeros((1, 1)))
    dealt = df.join(evaluate.folds(df), "id").select("id", "fold", "features")
    assert shared_tiles.subset_neighbours(dealt, {"0": [0]}, 3, 2).collect() == []
    assert shared_tiles.subset_neighbours(dealt.where("id > 3"), {"0": [0]}, 3, 2).collect() == []
