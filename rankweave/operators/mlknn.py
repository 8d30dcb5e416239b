"""ML-kNN: a label is predicted from how many of a row's neighbours have it, by Bayes' rule.

Everything is keyed by a group, so that many classifiers (feature subsets by folds) are fitted and used in one job. ``fit`` and ``predict`` take
one group. Rows: (grp, id, features, labels, train).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.knn import knn
from rankweave.plans.params import MlknnParams, params_of


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(grp, id, near, sim, rank): neighbours of all rows among the training rows of their group."""
    few = rows.where("train").groupBy("grp").count().agg(F.min("count")).first()[0] or 0
    most = min(k, max(1, few - 1))
    return knn(rows.select("grp", "id", "features"), rows.where("train").select("grp", "id", "features"), most)


def neighbour_counts(near: DataFrame, labels: DataFrame, label_k: DataFrame | None = None) -> DataFrame:
    """(grp, id, lid, c): how many of a row's nearest neighbours have the label; ``label_k`` (grp, lid, k): how many to look at."""
    of = labels.select(F.col("id").alias("near"), "labels")
    held = near.join(of, "near").groupBy("grp", "id").agg(F.collect_list(F.struct("rank", "labels")).alias("held"))
    each = held.select("grp", "id", "held", F.posexplode(F.element_at("held", 1)["labels"]).alias("lid", "y"))
    looked = F.col("held")
    if label_k is not None:
        each = each.join(F.broadcast(label_k.select("grp", "lid", "k")), ["grp", "lid"])
        looked = F.filter("held", lambda x: x["rank"] <= F.col("k"))
    return each.select("grp", "id", "lid", F.aggregate(looked, F.lit(0), lambda s, x: s + F.get(x["labels"], F.col("lid")).cast("int")).alias("c"))


def label_totals(rows: DataFrame) -> DataFrame:
    """(grp, lid, pos, n) of the training rows."""
    return rows.where("train").select("grp", F.posexplode("labels").alias("lid", "y")).groupBy("grp", "lid").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))


def adaptive_k(totals: DataFrame, params: MlknnParams) -> DataFrame:
    """(grp, lid, k): more neighbours for more frequent labels, k * (frequency / median of those above 0) ** power; halves round to even."""
    freq = totals.withColumn("freq", F.col("pos") / F.col("n"))
    median = freq.where("freq > 0").groupBy("grp").agg(F.percentile("freq", F.lit(0.5)).alias("median"))
    k = F.rint(params.k * F.pow(F.col("freq") / F.greatest(F.coalesce("median", F.lit(1e-3)), F.lit(1e-6)), F.lit(params.label_k_power)))
    return freq.join(median, "grp", "left").select("grp", "lid", F.least(F.greatest(k, F.lit(params.label_k_min)), F.lit(params.k)).cast("int").alias("k"))


@dataclass(frozen=True)
class Model:
    """prior (grp, lid, p1, p0), cond (grp, lid, c, p1, p0), label_k (grp, lid, k) or None."""

    prior: DataFrame
    cond: DataFrame
    label_k: DataFrame | None


def fit_from(rows: DataFrame, near: DataFrame, k: int, params: MlknnParams) -> Model:
    """The model of each group from neighbours of its training rows; ``k``: how many neighbours they have."""
    s, totals = params.s, label_totals(rows)
    prior = totals.select("grp", "lid", ((s + F.col("pos")) / (2 * s + F.col("n"))).alias("p1")).withColumn("p0", 1 - F.col("p1"))
    label_k = adaptive_k(totals, MlknnParams(k, s, True, min(params.label_k_min, k), params.label_k_power)) if params.label_adaptive_k else None
    train = rows.where("train")
    counts = neighbour_counts(near.join(train.select("grp", "id"), ["grp", "id"]), train.select("id", "labels").distinct(), label_k)
    truth = train.select("grp", "id", F.posexplode("labels").alias("lid", "y"))
    seen = truth.join(counts, ["grp", "id", "lid"], "left").groupBy("grp", "lid", F.coalesce("c", F.lit(0)).alias("c")).agg(F.sum("y").alias("ct"), F.sum(1 - F.col("y")).alias("cf"))
    limits = totals.withColumn("k", F.lit(k)) if label_k is None else totals.join(label_k, ["grp", "lid"])
    every = limits.select("grp", "lid", "pos", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("c"))
    ct, cf, cells = F.coalesce("ct", F.lit(0)), F.coalesce("cf", F.lit(0)), s * (F.col("k") + 1)
    cond = every.join(seen, ["grp", "lid", "c"], "left").select("grp", "lid", "c", ((s + ct) / (cells + F.col("pos"))).alias("p1"), ((s + cf) / (cells + F.col("n") - F.col("pos"))).alias("p0"))
    return Model(prior, cond, label_k)


def proba_from(ids: DataFrame, near: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(grp, id, lid, proba) of the rows in ``ids`` (grp, id); 0.5 where both likelihoods are 0, the prior where a label looks at no neighbour."""
    counts = neighbour_counts(near.join(ids, ["grp", "id"]), labels, model.label_k)
    likely = counts.join(model.cond.withColumnsRenamed({"p1": "l1", "p0": "l0"}), ["grp", "lid", "c"]).join(model.prior, ["grp", "lid"])
    pt, pf = F.col("p1") * F.col("l1"), F.col("p0") * F.col("l0")
    proba = F.when(pt + pf == 0, 0.5).otherwise(pt / (pt + pf))
    if model.label_k is not None:
        likely = likely.join(model.label_k, ["grp", "lid"])
        proba = F.when(F.col("k") <= 0, F.col("p1")).otherwise(proba)
    return likely.select("grp", "id", "lid", proba.alias("proba"))


@dataclass
class Mlknn:
    """A classifier of samples (id, features, labels)."""

    params: MlknnParams | dict | None = None
    model: Model | None = None

    def __post_init__(self) -> None:
        self.params = params_of(MlknnParams, self.params)

    def fit(self, samples: DataFrame) -> Mlknn:
        self.rows = samples.select(F.lit("").alias("grp"), "id", "features", "labels", F.lit(True).alias("train"))
        self.k = min(self.params.k, max(1, samples.count() - 1))
        self.near = neighbours(self.rows, self.k)
        self.model = fit_from(self.rows, self.near, self.k, self.params)
        return self

    def predict_proba(self, samples: DataFrame) -> DataFrame:
        """(id, lid, proba)."""
        if self.model is None:
            raise RuntimeError("the classifier has not been fitted")
        asked = samples.select(F.lit("").alias("grp"), "id", "features")
        near = knn(asked, self.rows.select("grp", "id", "features"), self.k)
        return proba_from(asked.select("grp", "id"), near, self.rows.select("id", "labels"), self.model).drop("grp")
