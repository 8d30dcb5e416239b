"""Places of rows in one order of all, against sorting them."""

import hashlib

import numpy as np
import pytest

from rankweave.operators import evaluate, fusion, ranks


@pytest.fixture
def small_units(monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 16)


def _scores(kind):
    rng = np.random.default_rng(5)
    if kind == "ties":
        return [0.0] * 300 + [float(x) for x in rng.integers(0, 9, 200)] + [-0.0] * 20
    if kind == "spread":
        return [float(x) for x in rng.normal(size=700)]
    return [1.5] if kind == "one" else []


@pytest.mark.parametrize("kind", ["ties", "spread", "one", "none"])
def test_places_and_tied_places(spark, small_units, kind):
    x = _scores(kind)
    df = spark.createDataFrame(list(enumerate(x)), "fid int, score double").repartition(7)
    best = sorted(range(len(x)), key=lambda i: (-x[i], i))
    assert [(r["rank"], r["fid"] - 1) for r in fusion.ranking(df).orderBy("rank").collect()] == [(n + 1, i) for n, i in enumerate(best)]
    assert sorted(r["fid"] for r in fusion.top_features(df, 9).collect()) == sorted(best[:9])
    shared = {v: (sum(w < v for w in x) + (sum(w == v for w in x) + 1) / 2 - 0.5) / len(x) for v in set(x)}
    got = {r["fid"]: r["score"] for r in fusion.rank_uniform(df).collect()}
    assert got == pytest.approx({i: shared[v] for i, v in enumerate(x)}, abs=1e-12)


def test_null_and_nan_scores(spark, small_units):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, float("nan")), (3, None), (4, 1.0)], "fid int, score double")
    assert [r["fid"] - 1 for r in fusion.ranking(df).orderBy("rank").collect()] == [2, 1, 4, 0, 3]
    assert {r["fid"]: r["score"] for r in fusion.rank_uniform(df).collect()} == pytest.approx({0: 0.2, 3: 0.2, 4: 0.5, 1: 0.7, 2: 0.9})


def test_folds_follow_one_order(spark):
    ids = [int(i) for i in np.random.default_rng(1).choice(10**6, 997, replace=False)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    order = sorted(ids, key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert {r["id"]: r["fold"] for r in evaluate.folds(df, 4, 7).collect()} == {i: n % 4 for n, i in enumerate(order)}


def test_no_window_over_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "fid int, score double")
    for plan in (fusion.ranking(df), fusion.rank_uniform(df), evaluate.folds(df.withColumnRenamed("fid", "id"))):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all(", [" in line.split("]", 1)[1] for line in windows)
