"""The solver without matrices of features by features, of features by targets, or of labels by labels in one place."""

import resource

import numpy as np
import pytest

from rankweave.operators import sharded, solver
from rankweave.plans.params import EmbeddedParams


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, labels array<tinyint>").repartition(parts)


@pytest.fixture(scope="module")
def samples(spark):
    rnd = np.random.default_rng(4)
    x = rnd.random((60, 7))
    y = (x[:, :3] + 0.2 * rnd.standard_normal((60, 3)) > 0.6).astype(int)
    return frame(spark, x, y).persist(), x, y


def rows_of(df):
    return solver.prepared(df, EmbeddedParams())


@pytest.mark.parametrize("alpha", [0.0, 0.35])
@pytest.mark.parametrize("block", [3, 100])
def test_weights_in_blocks_take_the_same_steps(samples, alpha, block):
    df, x, _ = samples
    start = np.random.default_rng(1).standard_normal((7, 3)) * 0.1
    p = EmbeddedParams(alpha=alpha, max_iter=4, power_iter=3, tol=0.0)
    want_rows, want = solver.fit_embedded(df, p, start)
    got_rows, got = solver.fit_embedded(df, p, start, block)
    w = np.array([r["w"] for r in got["weights"].orderBy("fid").collect()])
    assert np.allclose(w, want["weights"], atol=1e-10) and np.allclose(got["bias"], want["bias"], atol=1e-10)
    assert abs(got["xtx_eig"] - want["xtx_eig"]) < 1e-9 and np.allclose(got["objectives"], want["objectives"], atol=1e-10)
    assert np.allclose(got["score_minmax"], want["score_minmax"]) and got["iterations"] == want["iterations"] == 4
    assert [r["fid"] for r in got_rows.orderBy("rank").collect()] == [r["fid"] for r in want_rows.orderBy("rank").collect()]


def test_products_move_partial_sums_only(samples):
    df, x, y = samples
    tiles = sharded.tiled(rows_of(df), 7, 3, 2)
    w = np.random.default_rng(2).standard_normal((7, 2))
    met = tiles.times(sharded.blocks_of(df.sparkSession, tiles, lambda at, k: w[at : at + k]), 2)
    got = np.concatenate([np.frombuffer(r["v"]).reshape(-1, 2) for r in met.collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(x @ w, axis=0))
    # tiles are dealt already: no exchange lies between them and the join
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert not any("x#" in line and "Exchange" in line for line in plan.splitlines())


def test_small_partitions_make_few_tasks_and_few_feature_blocks_many(samples):
    df, x, _ = samples
    spark, w = df.sparkSession, np.random.default_rng(3).standard_normal((7, 2))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tiles = sharded.tiled(rows_of(df.repartition(20)), 7, 3, 4, 60)
        met = tiles.times(sharded.blocks_of(spark, tiles, lambda at, k: w[at : at + k]), 2)
        got = np.concatenate([np.frombuffer(r["v"]).reshape(-1, 2) for r in met.collect()])
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert np.allclose(np.sort(got, axis=0), np.sort(x @ w, axis=0))
    assert tiles.by_rows.rdd.getNumPartitions() <= 4 and tiles.by_features.rdd.getNumPartitions() <= 8
    assert tiles.by_features.select("fb", "part").distinct().count() > 2
    assert not any("x#" in line and "Exchange" in line for line in plan.splitlines())


def test_characters_are_counted_before_texts_would_move(spark, data):
    from rankweave.sources.samples import text_counts, text_rows

    plan = text_counts(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("translate(")
    # and once only: what follows reads the counts
    assert "parquet" not in text_rows(spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_iter", [3, 25])
def test_the_eigenvalue_needs_no_gram_matrix(samples, n_iter):
    df = samples[0]
    rows = sharded.row_blocks(rows_of(df))
    want = solver.greatest_eigenvalue(solver.gram(rows_of(df), 7), n_iter)
    assert abs(solver.matrix_free_eigenvalue(rows, 7, n_iter) - want) < 1e-9
    assert abs(solver.gram(rows, 7) - solver.gram(rows_of(df), 7)).max() < 1e-9


def test_the_eigenvalue_of_nothing(spark):
    df = frame(spark, np.zeros((4, 3)), np.ones((4, 2), int))
    assert solver.matrix_free_eigenvalue(sharded.row_blocks(rows_of(df)), 3) == 0.0


def test_twenty_thousand_features(spark):
    d = 20_000  # a Gram matrix would take 3.2 GB
    rnd = np.random.default_rng(6)
    x = rnd.random((12, d)) + np.outer(rnd.random(12), np.ones(d))
    df = frame(spark, x, (rnd.random((12, 3)) > 0.5).astype(int), 2)
    p = EmbeddedParams(alpha=0.0, use_instance_weights=False, max_iter=2, power_iter=8, tol=0.0)
    _, facts = solver.fit_embedded(df, p, np.zeros((d, 3)))
    assert abs(facts["xtx_eig"] - np.linalg.eigvalsh(x @ x.T)[-1]) < 1e-6 * facts["xtx_eig"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20 and len(facts["scores"]) == d


@pytest.mark.parametrize(("n_labels", "rank"), [(60, 4), (60, 60), (5, 2)])
def test_the_range_finder_gives_the_leading_directions(spark, n_labels, rank):
    rnd = np.random.default_rng(n_labels + rank)
    kinds = rnd.random((6, n_labels)) < np.linspace(0.1, 0.6, 6)[:, None]
    y = (kinds[rnd.integers(0, 6, 200)] ^ (rnd.random((200, n_labels)) < 0.05)).astype(int)
    df = frame(spark, rnd.random((200, 2)), y)
    v, lw = solver.embedding(df, rank, 1.2, 200, n_labels, dense_labels=0)
    want, _ = solver.embedding(df, rank, 1.2, 200, n_labels, dense_labels=1000)
    assert v.shape == want.shape == (n_labels, rank) and np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
    # the sine of the greatest angle between both spaces
    assert np.linalg.norm(v - want @ (want.T @ v), 2) < 1e-6
    of = (y * lw) @ v
    assert np.allclose(of.T @ of, np.diag(np.linalg.eigvalsh((y * lw).T @ (y * lw))[::-1][:rank]), atol=1e-6)
