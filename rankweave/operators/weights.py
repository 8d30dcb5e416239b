"""Label frequencies and the weights of labels and samples that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.columns import pattern
from rankweave.sources.samples import label_values

EPS = 1e-12


def label_freq(samples: DataFrame) -> DataFrame:
    """(lid, freq): positives plus one."""
    return label_values(samples).groupBy("lid").agg((F.sum("y") + 1).cast("double").alias("freq"))


def rarity_prior(samples: DataFrame, gamma: float = 2.0) -> DataFrame:
    """(lid, freq, prior): prior in proportion to freq ** -gamma. The window is over one row per label."""
    p = F.pow("freq", F.lit(-gamma))
    return label_freq(samples).select("lid", "freq", (p / (F.sum(p).over(Window.partitionBy()) + EPS)).alias("prior"))


def tail_weights(samples: DataFrame, label_gamma: float = 0.0) -> DataFrame:
    """(lid, weight): freq ** (-gamma / 2) over its mean."""
    w = F.pow("freq", F.lit(-label_gamma / 2))
    return label_freq(samples).select("lid", (w / (F.avg(w).over(Window.partitionBy()) + EPS)).alias("weight"))


def pattern_counts(samples: DataFrame) -> DataFrame:
    """(pattern, n, labels)."""
    return samples.groupBy(pattern(F.col("labels")).alias("pattern")).agg(F.count("*").alias("n"), F.first("labels").alias("labels"))


def pattern_weights(samples: DataFrame, gamma: float = 2.0, kappa: float = 1.5, s_max: float = 3.0) -> DataFrame:
    """(pattern, n, s): a sample's weight depends only on its label pattern: least(1 + kappa <y, prior>, s_max) over its mean."""
    pats = pattern_counts(samples)
    long = pats.select("pattern", "n", F.posexplode("labels").alias("lid", "y"))
    raw = long.join(rarity_prior(samples, gamma), "lid").groupBy("pattern", "n").agg(F.least(1 + kappa * F.sum(F.col("y") * F.col("prior")), F.lit(s_max)).alias("raw"))
    return beside(raw, raw.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("mean"))).select("pattern", "n", (F.col("raw") / (F.col("mean") + EPS)).alias("s"))


def weighted(samples: DataFrame, gamma: float = 2.0, kappa: float = 1.5, s_max: float = 3.0) -> DataFrame:
    """``samples`` with ``s``, as of ``pattern_weights``. The priors (as long as a row of labels) and the mean go to the rows, which stay where they are: a join by pattern
    would put all rows of a frequent pattern into one task."""
    prior = rarity_prior(samples, gamma).agg(F.sort_array(F.collect_list(F.struct("lid", "prior"))).alias("priors"))

    def raw(labels: Column) -> Column:
        each = F.zip_with(labels, "priors", lambda y, p: F.coalesce(y * p["prior"], F.lit(0.0)))
        return F.least(1 + kappa * F.aggregate(each, F.lit(0.0), lambda a, v: a + v), F.lit(s_max))

    pats = beside(pattern_counts(samples), prior).select("n", raw(F.col("labels")).alias("raw"))
    one = beside(prior, pats.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("mean")))
    return beside(samples, one).withColumn("s", raw(F.col("labels")) / (F.col("mean") + EPS)).drop("priors", "mean")


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row (an aggregate), so that no task orders or holds all rows."""
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").drop("one")


def instance_weights(samples: DataFrame, gamma: float = 2.0, kappa: float = 1.5, s_max: float = 3.0) -> DataFrame:
    """(id, s, sw): weights and their roots."""
    of = pattern_weights(samples, gamma, kappa, s_max).select("pattern", "s")
    return samples.select("id", pattern(F.col("labels")).alias("pattern")).join(of, "pattern").select("id", "s", F.sqrt("s").alias("sw"))


def spectral_pattern_weights(samples: DataFrame, gamma: float) -> DataFrame:
    """(pattern, n, w): (sum of a row's inverse label frequencies) ** gamma over its mean; raises where no row has a label."""
    pats = pattern_counts(samples)
    long = pats.select("pattern", "n", F.posexplode("labels").alias("lid", "y"))
    mean = long.groupBy("lid").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("freq"))
    raw = long.join(mean, "lid").groupBy("pattern", "n").agg(F.pow(F.sum(F.col("y") / F.greatest("freq", F.lit(1e-10))), F.lit(gamma)).alias("raw"))
    total = raw.agg(F.sum(F.col("raw") * F.col("n")).alias("total"), F.sum("n").alias("rows"))
    checked = F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("instance weights need a positive label")).cast("double"))
    return beside(raw, total).select("pattern", "n", (F.col("raw") / (checked / F.col("rows"))).alias("w"))


def label_gram(samples: DataFrame) -> DataFrame:
    """(l1, l2, n): in how many rows two labels meet, from the patterns."""
    long = pattern_counts(samples).select("pattern", "n", F.posexplode("labels").alias("lid", "y")).where("y > 0").select("pattern", "n", "lid")
    a, b = long.select("pattern", "n", F.col("lid").alias("l1")), long.select("pattern", F.col("lid").alias("l2"))
    return a.join(b, "pattern").groupBy("l1", "l2").agg(F.sum("n").alias("n"))


def weighted_labels(samples: DataFrame, label_gamma: float) -> DataFrame:
    """(id, lid, value): positive labels by their tail weights."""
    return label_values(samples).where("y > 0").join(tail_weights(samples, label_gamma), "lid").select("id", "lid", F.col("weight").alias("value"))
