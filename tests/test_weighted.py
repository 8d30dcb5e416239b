"""Weights of rows by the priors of labels, against those by patterns; rows stay where they are."""

import numpy as np
from pyspark.sql import functions as F
from test_ranking import frame

from rankweave.functions.columns import pattern
from rankweave.operators import solver, weights
from rankweave.plans.params import EmbeddedParams


def test_weights_are_those_of_the_patterns(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.random((80, 2)), (rng.random((80, 4)) < [0.05, 0.3, 0.6, 0.9]).astype(int))
    by_pattern = {r["pattern"]: r["s"] for r in weights.pattern_weights(df, 1.5, 4.0, 2.5).collect()}
    got = weights.weighted(df, 1.5, 4.0, 2.5).select(pattern(F.col("labels")).alias("p"), "s").collect()
    assert len(got) == 80 and all(abs(r["s"] - by_pattern[r["p"]]) < 1e-12 for r in got)


def test_a_frequent_pattern_stays_in_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(0, 2000, 1, 8).select("id", F.array(F.col("id").cast("double")).alias("features"), F.array(F.lit(1), F.lit(0)).cast("array<tinyint>").alias("labels"))
        at = solver.prepared(rows, EmbeddedParams()).groupBy(F.spark_partition_id()).count().collect()
        assert len(at) == 8 and sum(r["count"] for r in at) == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
