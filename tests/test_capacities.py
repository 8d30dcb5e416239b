"""The queries of the capacity search against all pairs of the reference's grid judged one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import queries
from rankweave.operators import evaluate, fusion, solver, spectral
from rankweave.plans.params import EmbeddedParams, SelectionParams, SpectralParams
from rankweave.sources import samples as S

#: The default grid.
GRID = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def slow_mlknn(x, y, train, test, k=10):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 10)
    near = {i: sorted((j for j in train if j != i), key=lambda j: (-sims[i, j], j))[:k] for i in range(len(x))}
    out = np.zeros((len(test), y.shape[1]), int)
    for lid in range(y.shape[1]):
        pos, n = y[train, lid].sum(), len(train)
        tally = np.zeros((2, k + 1))
        for i in train:
            tally[y[i, lid], y[near[i], lid].sum()] += 1
        for r, i in enumerate(test):
            c = y[near[i], lid].sum()
            pt = (1 + pos) / (2 + n) * (1 + tally[1, c]) / (k + 1 + pos)
            pf = (1 + n - pos) / (2 + n) * (1 + tally[0, c]) / (k + 1 + n - pos)
            out[r, lid] = pt / (pt + pf) >= 0.5
    return out


def slow_scores(x, y, fold, e, s):
    """gm of each pair of capacities."""
    out = {}
    for mu_e in GRID:
        for mu_s in GRID:
            fused = [b + (a - b) * mu_e if a >= b else a + (b - a) * mu_s for a, b in zip(e, s, strict=True)]
            chosen = sorted(sorted(range(len(e)), key=lambda f: (-fused[f], f))[: max(1, round(0.2 * len(e)))])
            micro, macro = [], []
            for f in range(3):
                test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                p, t = slow_mlknn(x[:, chosen], y, train, test), y[test]
                tp, both = (p * t).sum(0), p.sum(0) + t.sum(0)
                micro.append(2 * tp.sum() / max(both.sum(), 1e-12))
                macro.append(np.mean([2 * a / b for a, b in zip(tp, both, strict=True) if b]) if both.any() else 0.0)
            out[mu_e, mu_s] = float(np.sqrt(np.mean(micro) * np.mean(macro)))
    return out


@pytest.fixture
def small(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.random((60, 15))
    y = (x[:, :3] + 0.4 * rng.random((60, 3)) > 0.7).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in a], [int(v) for v in b]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, labels array<tinyint>").cache()
    monkeypatch.setattr(S, "vectors", lambda spark, d: df)
    fold = np.array([r["fold"] for r in evaluate.folds(df).orderBy("id").collect()])
    return df, x, y, fold


def values(df):
    return [r["score"] for r in df.orderBy("fid").collect()]


def judged(spark):
    """What the query shows, before it is rounded."""
    rows = S.vectors(spark, "")
    x = S.feature_values(rows).groupBy("fid").agg(F.sum(F.col("val") * F.col("val")).alias("score"))
    s = spectral.spectral_scores(rows).select("fid", "score")
    return evaluate.capacity_scores(rows, fusion.rank_uniform(x), fusion.rank_uniform(s), SelectionParams(mlknn_k=queries.K)).collect()


def test_capacity_search_judges_the_whole_grid(spark, small):
    df, x, y, fold = small
    s = values(fusion.rank_uniform(spectral.spectral_scores(df).select("fid", "score")))
    e = (np.argsort(np.argsort((x * x).sum(0))) + 0.5) / x.shape[1]
    want = slow_scores(x, y, fold, e.tolist(), s)
    got = {(r["mu_e"], r["mu_s"]): r["gm"] for r in judged(spark)}
    assert set(got) == set(want) and len(got) == 36
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_pipeline_full_fuses_by_the_best_of_the_whole_grid(spark, small):
    df, x, y, fold = small
    first = solver.fit_embedded(df, EmbeddedParams())[0]
    e = values(fusion.rank_uniform(first.select((first.fid - 1).alias("fid"), "score")))
    s = values(fusion.rank_uniform(spectral.spectral_scores(df, SpectralParams(alpha=0.70)).select("fid", "score")))
    scores = slow_scores(x, y, fold, e, s)
    mu_e, mu_s = min(scores, key=lambda p: (-round(scores[p], 12), p))
    fused = [b + (a - b) * mu_e if a >= b else a + (b - a) * mu_s for a, b in zip(e, s, strict=True)]
    want = sorted(range(len(e)), key=lambda f: (-fused[f], f))
    got = queries.pipeline_full(spark, "").orderBy("rank").collect()
    assert [r["fid"] - 1 for r in got] == want and np.allclose([r["score"] for r in got], [fused[f] for f in want])
