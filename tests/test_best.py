"""The grid of cells and the search in one, against every pair; how much moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ranking import frame

from rankweave.operators import best, evaluate, knn, mlknn
from rankweave.operators import sparse as sp
from rankweave.plans.params import MlknnParams


@pytest.mark.parametrize("many", [0, 2, 64])
@pytest.mark.parametrize("k", [1, 5, 80])
def test_scan_finds_what_a_whole_sort_finds(monkeypatch, many, k):
    monkeypatch.setattr(best, "CHUNK", 16)
    monkeypatch.setattr(best, "MANY", many)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (60, 6)).astype(float)
    x[20:40], x[50] = x[3], np.nan
    u, ids = knn.unit_rows(x), rng.permutation(60)
    row, col, sim = best.dense_scan(u, ids, ids, u.astype(np.float32), lambda at: u[at], k, 7)
    sims = np.round(u @ u.T, 10)
    for i in range(60):
        able = [j for j in range(60) if j != i and np.isfinite(sims[i, j])]
        assert col[row == i].tolist() == sorted(able, key=lambda j: (-sims[i, j], ids[j]))[:k]
        assert np.array_equal(sim[row == i], sims[i, col[row == i]])


def test_blocks_move_once_for_each_group_not_for_each_block(spark):
    rows = spark.range(3000).select(F.lit("").alias("grp"), "id", F.array(F.rand(1)).alias("features"))
    cells = best.grid(rows, rows, 10, F.struct("id", "features"), F.lit(8))
    cores = spark.sparkContext.defaultParallelism
    moved = cells.agg(F.sum(F.size("held"))).first()[0]
    assert moved == 3000 * (best.GROUPS + 2 * cores)
    assert cells.rdd.getNumPartitions() == best.GROUPS * 2 * cores


@pytest.mark.parametrize("common", [1, 3, 1000])
def test_sparse_products_with_common_features_as_columns(monkeypatch, common):
    monkeypatch.setattr(sp, "COMMON", common)
    made = []
    monkeypatch.setattr(sp, "products", lambda left, x, first, count, *rest, of=sp.products: made.append(int(count.sum())) or of(left, x, first, count, *rest))
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=(n, 12)) * (rng.random((n, 12)) < p) for n, p in ((19, 0.5), (23, np.linspace(0, 1, 12))))
    x, y = (sp.SparseBlock(12, (m != 0).sum(axis=1), np.nonzero(m)[1].astype(np.int32), m[np.nonzero(m)]) for m in (a, b))
    assert np.allclose(x.times_rows_of(y), a @ b.T, atol=1e-12)
    assert sum(made) < ((a != 0).sum(axis=0) * (b != 0).sum(axis=0)).sum()


@pytest.mark.parametrize("adaptive", [False, True])
def test_outcomes_are_the_predictions_counted(spark, adaptive):
    rng = np.random.default_rng(9)
    x = rng.random((70, 4))
    df = frame(spark, x, (x[:, :3] + 0.3 * rng.random((70, 3)) > [0.3, 0.7, 1.0]).astype(int)).cache()
    groups = spark.createDataFrame([("0,1", [0, 1]), ("0,1,2", [0, 1, 2])], "subset string, selected array<int>")
    p = MlknnParams(k=6, label_adaptive_k=adaptive, label_k_min=2)
    rows = evaluate.fold_predictions(df, groups, p, 3, 42)
    counted = rows.groupBy("subset", "fold", "lid", "pred", "y").count()
    held = evaluate.judged(df, groups, p, 3, 42).outcomes.groupBy("subset", "fold", "lid", "pred", "y").agg(F.sum("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, held.collect()))
    fold = evaluate.folds(df)
    for t in range(3):  # the classifier of each fold by itself
        part = df.withColumn("features", F.slice("features", 1, 2)).join(fold, "id")
        model = mlknn.Mlknn(p).fit(part.where(F.col("fold") != t).drop("fold"))
        want = {(r["id"], r["lid"]): int(r["proba"] >= 0.5) for r in model.predict_proba(part.where(F.col("fold") == t).drop("fold")).collect()}
        assert {(r["id"], r["lid"]): r["pred"] for r in rows.where((F.col("subset") == "0,1") & (F.col("fold") == t)).collect()} == want
