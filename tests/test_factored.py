"""Cosine and Hamming graphs in factors give what the written graph gives, and no pair of patterns."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ranking import dense_spectral, frame

from rankweave.functions import columns as C
from rankweave.operators import spectral, weights
from rankweave.plans.params import SpectralParams


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x, y = rng.random((80, 4)), (rng.random((80, 6)) < 0.3).astype(int)
    y[:9], y[9:12] = 0, 1
    return frame(spark, x, y).cache(), x, y


def written(df, p):
    """The graph with its edges."""
    of = spectral.label_graph(df, p)
    pats = weights.pattern_counts(df)
    return spectral.Graph(of.nodes.select("node", "n", "own"), spectral.pattern_edges(pats, p.label_sim), of.stats)


def table(df, *keys):
    return {tuple(r[k] for k in keys): [v for k, v in sorted(r.asDict().items()) if k not in keys] for r in df.collect()}


@pytest.mark.parametrize("sim", ["cosine", "hamming"])
@pytest.mark.parametrize("loops", [False, True])
def test_factors_are_the_written_graph(rows, sim, loops):
    df, x, y = rows
    p = SpectralParams(label_sim=sim, label_self_loops=loops)
    of = spectral.label_graph(df, p)
    assert isinstance(of, spectral.Factored)
    for got, want, key in ((of.degrees(), written(df, p).degrees(), "node"), (of.quadratic(), written(df, p).quadratic(), "fid")):
        got, want = table(got, key), table(want, key)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    scores = [r["score"] for r in spectral.spectral_scores(df, p).orderBy("fid").collect()]
    assert np.allclose(scores, dense_spectral(x, y, sim, 0.5, loops), atol=1e-9)


def test_no_pair_of_patterns_is_made(rows):
    """One join of values with nodes and two of nodes with sums by label; nothing meets itself on a label."""
    plan = spectral.spectral_scores(rows[0], {"label_sim": "hamming"})._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(labels" not in plan and plan.count("Join") == 3


@pytest.mark.parametrize("sim", ["cosine", "hamming"])
def test_odd_labels(spark, sim):
    """No positive label at all, one row, and no rows."""
    none = frame(spark, [[0.1, 1], [0.5, 2], [0.9, 0]], [[0, 0]] * 3)
    got = spectral.spectral_scores(none, {"label_sim": sim}).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    one = spectral.label_graph(none.limit(1), {"label_sim": sim})
    assert [r["deg"] for r in one.degrees().collect()] == [0.0]
    assert spectral.spectral_scores(none.where("id > 5"), {"label_sim": sim}).collect() == []


def test_unit_vectors_take_one_length_a_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id int, v array<double>")
    got = {r["id"]: r["u"] for r in df.select("id", C.unit(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [], 4: None}
