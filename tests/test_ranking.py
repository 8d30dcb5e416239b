"""Properties, small cases by hand, and a dense solver written from the formulas."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.functions import columns as C
from rankweave.operators import evaluate, fusion, mlknn, solver, spectral, weights
from rankweave.plans.params import EmbeddedParams, MlknnParams, SpectralParams
from rankweave.plans.pipeline import rank_features
from rankweave.sources import samples as S


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], [int(v) for v in b]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, labels array<tinyint>")


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((60, 5)), (rng.random((60, 3)) < 0.4).astype(int)
    return frame(spark, x, y), x, y


def dense_spectral(x, y, sim="jaccard", alpha=0.5, loops=False, gamma=0.0):
    n = len(x)
    both, c = y @ y.T, y.sum(1)
    a = {"jaccard": both / np.maximum(c[:, None] + c - both, 1e-10), "cosine": both / np.maximum(np.sqrt(np.outer(c, c)), 1e-10), "hamming": (both + (1 - y) @ (1 - y).T) / y.shape[1]}[sim].astype(float)
    np.fill_diagonal(a, 1.0 if loops else 0.0)
    deg = a.sum(1)
    d = np.where(deg > 1e-10, 1 / np.sqrt(np.maximum(deg, 1e-300)), 0)
    if gamma:
        w = ((y / np.maximum(y.mean(0), 1e-10)).sum(1)) ** gamma
        x = x * (w / w.mean())[:, None]
    h = np.eye(n) - 1 / n
    xx = (x * x).sum(0) + 1e-10
    e, k = np.einsum("if,ij,jf->f", x, np.eye(n) - d[:, None] * a * d, x) / xx, np.einsum("if,ij,jf->f", x, h @ a @ h, x) / xx
    scale = lambda v: np.full(len(v), 0.5) if np.ptp(v) < 1e-10 else (v - v.min()) / np.ptp(v)
    return (1 - alpha) * (1 - scale(e)) + alpha * scale(k)


@pytest.mark.parametrize("given", [{}, {"label_sim": "cosine"}, {"label_sim": "hamming", "alpha": 0.7}, {"label_self_loops": True}])
def test_spectral_is_the_dense_form(toy, given):
    df, x, y = toy
    got = [r["score"] for r in spectral.spectral_scores(df, given).orderBy("fid").collect()]
    want = dense_spectral(x, y, given.get("label_sim", "jaccard"), given.get("alpha", 0.5), given.get("label_self_loops", False))
    assert np.allclose(got, want, atol=1e-9)


def test_labels_without_positives_make_constant_scores(spark):
    df = frame(spark, [[0.1, 1], [0.5, 2], [0.9, 0]], [[0, 0]] * 3)
    assert [r["score"] for r in spectral.spectral_scores(df).collect()] == [0.5, 0.5]
    with pytest.raises(Exception, match="positive label"):
        spectral.spectral_scores(df, SpectralParams(instance_weight_gamma=1.0)).collect()


def test_unknown_similarity():
    with pytest.raises(ValueError):
        SpectralParams(label_sim="dice")


def test_weights_have_mean_one(toy):
    s = [r["s"] for r in weights.instance_weights(toy[0]).collect()]
    assert abs(np.mean(s) - 1) < 1e-9 and min(s) > 0
    assert abs(sum(r["prior"] for r in weights.rarity_prior(toy[0]).collect()) - 1) < 1e-9


def test_ties_share_a_rank(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 1.0), (3, 0.0)], "fid int, score double")
    assert {r["fid"]: r["score"] for r in fusion.rank_uniform(df).collect()} == {3: 0.125, 0: 0.5, 2: 0.5, 1: 0.875}
    assert fusion.rank_uniform(df.limit(1)).first()["score"] == 0.5
    assert [r["fid"] for r in fusion.ranking(df).orderBy("rank").collect()] == [2, 1, 3, 4]


@settings(max_examples=15, deadline=None)
@given(st.floats(0, 1), st.floats(0, 1), st.floats(0, 1))
def test_choquet_identities(spark, e, s, m):
    at = lambda a, b: C.choquet(F.lit(e), F.lit(s), F.lit(a), F.lit(b))
    row = spark.range(1).select(at(1.0, 1.0), at(0.0, 0.0), at(1.0, 0.0), at(0.0, 1.0), at(m, 1 - m)).first()
    assert np.allclose(row, [max(e, s), min(e, s), e, s, m * e + (1 - m) * s])


def test_selected_share_rounds_half_to_even():
    assert [fusion.n_selected(d, 0.1) for d in (3, 15, 25, 26)] == [1, 2, 2, 3]


def dense_embedded(x, y, p, v, lw, s, steps):
    t_ = (y * lw) @ v
    w = 0.01 * np.random.default_rng(p.seed).standard_normal((x.shape[1], v.shape[1]))
    b = np.zeros(y.shape[1])
    z, zb, t = w.copy(), b.copy(), 1.0
    lam = np.linalg.eigvalsh(x.T @ (x * s[:, None]))[-1]
    ew, eb = 0.9 / (((1 - p.alpha) + p.alpha / 4) * lam + 2 * p.rho), 0.9 / (p.alpha / 4 * s.sum() + 1e-12)
    for _ in range(steps):
        e = s[:, None] * (1 / (1 + np.exp(-(x @ z @ v.T + zb))) - y)
        g = (1 - p.alpha) * x.T @ (s[:, None] * (x @ z - t_)) + p.alpha * x.T @ (e @ v) + 2 * p.rho * z
        u = z - ew * g
        new = u * np.maximum(0, 1 - ew * p.beta / (np.linalg.norm(u, axis=1, keepdims=True) + 2e-16))
        nb = zb - eb * p.alpha * e.sum(0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb, w, b, t = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b), new, nb, t2
    return np.linalg.norm(w, axis=1)


@pytest.mark.parametrize("alpha", [0.0, 0.35])
def test_solver_is_the_dense_recurrence(toy, alpha):
    df, x, y = toy
    p = EmbeddedParams(alpha=alpha, max_iter=12, tol=0.0, power_iter=300)
    _, facts = solver.fit_embedded(df, p)
    s = {r["id"]: r["s"] for r in weights.instance_weights(df).collect()}
    want = dense_embedded(x, y, p, facts["V"], np.ones(3), np.array([s[i] for i in range(len(x))]), 12)
    assert np.allclose(facts["scores"], want, atol=1e-6) and facts["iterations"] == 12


def test_strong_penalty_gives_zero_weights(toy):
    ranking, facts = solver.fit_embedded(toy[0], EmbeddedParams(alpha=0.0, beta=1e9, max_iter=5))
    assert not facts["scores"].any() and [r["fid"] for r in ranking.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_shrinking_rows():
    w = np.array([[3.0, 4.0], [0.3, 0.4]])
    assert np.allclose(solver.shrink_rows(w, 1.0), [[2.4, 3.2], [0, 0]])


def test_power_iteration():
    g = np.diag([5.0, 1.0, 0.5])
    assert abs(solver.greatest_eigenvalue(g, 100) - 5) < 1e-9 and solver.greatest_eigenvalue(np.zeros((3, 3))) == 0.0


def test_mlknn_excludes_the_row_itself_and_clamps_k(spark):
    df = frame(spark, [[1, 0], [1, 0], [0, 1]], [[1, 0], [0, 1], [1, 1]])
    model = mlknn.Mlknn(MlknnParams(k=10)).fit(df)
    assert model.k == 2 and {(r["id"], r["near"]) for r in model.near.where("rank = 1").collect()} == {(0, 1), (1, 0), (2, 0)}
    assert all(0 < r["proba"] < 1 for r in model.predict_proba(df).collect())
    with pytest.raises(RuntimeError):
        mlknn.Mlknn().predict_proba(df)


def test_bad_parameters():
    for bad in ({"k": 0}, {"s": 0}, {"k": 2, "label_k_min": 3}):
        with pytest.raises(ValueError):
            MlknnParams(**bad)


def test_macro_f1_leaves_out_empty_labels(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (1, 0, 0)], "lid int, pred int, y int").withColumn("fold", F.lit(0))
    assert abs(evaluate.macro_f1(rows, "fold").first()["macro"] - 2 / 3) < 1e-9


def test_both_label_signs(spark):
    one, two = frame(spark, [[1.0]], [[1, 0]]), frame(spark, [[1.0]], [[1, -1]])
    assert one.select(C.pattern(F.col("labels"))).first() == two.select(C.pattern(C.binarized(F.col("labels")))).first()


def test_ragged_samples_raise(spark):
    with pytest.raises(ValueError):
        S.sizes(frame(spark, [[1.0], [1.0, 2.0]], [[1], [1]]))


def test_variants(toy):
    assert rank_features(toy[0], "simple")[0].count() == 5
    with pytest.raises(ValueError):
        rank_features(toy[0], "other")
