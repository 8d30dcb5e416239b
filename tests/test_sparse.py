"""Sparse samples against dense ones: products of blocks, the embedded fit, neighbours and ML-kNN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import columns as C
from rankweave.operators import knn, mlknn, solver
from rankweave.operators import sparse as sp
from rankweave.plans.params import EmbeddedParams, MlknnParams
from rankweave.sources import samples as S


def block(x):
    row, col = np.nonzero(x)
    return sp.SparseBlock(x.shape[1], np.bincount(row, minlength=len(x)), col.astype(np.int32), x[row, col])


@pytest.fixture(params=[1, 1 << 22])
def spread(request, monkeypatch):
    monkeypatch.setattr(sp, "SPREAD", request.param)


def test_products(spread):
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(n, 9)) * (rng.random((n, 9)) < 0.3) for n in (17, 6))
    a[4] = a[0] = b[5] = 0
    m, v, s = rng.normal(size=(9, 4)), rng.normal(size=9), rng.random(17)
    x, y = block(a), block(b)
    for got, want in ((x @ m, a @ m), (x @ v, a @ v), (x.T @ s, a.T @ s), (x.T @ (a @ m), a.T @ (a @ m)), (x.gram(s), (a * s[:, None]).T @ a), (x.times_rows_of(y), a @ b.T), (x.unit().times_rows_of(y.unit()), knn.unit_rows(a) @ knn.unit_rows(b).T)):
        assert np.allclose(got, want, atol=1e-12)
    assert block(np.zeros((3, 9))).times_rows_of(y).shape == (3, 6)


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(8)
    x = rng.random((90, 7)) * (rng.random((90, 7)) < 0.4)
    x[5] = 0
    y = (x[:, :3] + 0.3 * rng.random((90, 3)) > 0.4).astype(int)
    df = S.assemble(spark.createDataFrame([(i, *map(float, a), *map(int, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], ["id", *[f"x{i}" for i in range(7)], *[f"y{i}" for i in range(3)]]), "id", [F.col(f"x{i}") for i in range(7)], [F.col(f"y{i}") for i in range(3)])
    return df, df.withColumn("features", sp.sparse(F.col("features")))


def test_layout_and_unit_norm(spark, both):
    got = both[1].select("id", sp.unit_sparse(F.col("features")).alias("u")).join(both[0].select("id", C.unit(F.col("features")).alias("v")), "id").collect()
    for r in got:
        v = np.zeros(r["u"]["size"])
        v[r["u"]["indices"]] = r["u"]["values"]
        assert np.allclose(v, r["v"], atol=1e-15)
    odd = spark.createDataFrame([([],), ([0.0, None, float("nan"), -2.0],)], "features array<double>").select(sp.sparse(F.col("features")).alias("f")).collect()
    assert tuple(odd[0]["f"]) == (0, [], []) and odd[1]["f"]["indices"] == [2, 3] and odd[1]["f"]["size"] == 4


@pytest.mark.parametrize("alpha,gram_features", [(0.35, 1024), (0.35, 2), (0.0, 1024)])
def test_embedded_fit(both, monkeypatch, alpha, gram_features):
    monkeypatch.setattr(solver, "GRAM_FEATURES", gram_features)
    dense, sparse = (solver.fit_embedded(df, EmbeddedParams(alpha=alpha, max_iter=6))[1] for df in both)
    assert dense["d"] == sparse["d"] == 7 and dense["xtx_eig"] == pytest.approx(sparse["xtx_eig"], abs=1e-9)
    assert np.allclose(dense["weights"], sparse["weights"], atol=1e-10) and np.allclose(dense["objectives"], sparse["objectives"], atol=1e-10)
    with pytest.raises(ValueError, match="dense"):
        solver.fit_embedded(both[1], EmbeddedParams(max_iter=1), feature_block=4)


@pytest.mark.parametrize("rows", [7, 2048])
def test_classifier(both, monkeypatch, rows):
    monkeypatch.setattr(knn, "BLOCK", rows)
    dense, sparse = ({(r["id"], r["lid"]): r["proba"] for r in mlknn.Mlknn(MlknnParams(k=4)).fit(df.where("id < 60")).predict_proba(df.where("id >= 60")).collect()} for df in both)
    assert len(dense) == 90 and dense == pytest.approx(sparse, abs=1e-9)
