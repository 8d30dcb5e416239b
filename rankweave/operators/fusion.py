"""Rank normalisation, Choquet fusion and rankings; ranks are counted in parts, no task orders all features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.columns import choquet
from rankweave.operators.ranks import places, tied_places


def rank_uniform(scores: DataFrame, name: str = "score") -> DataFrame:
    """(fid, name): empirical distribution value with averaged ties, (rank - 0.5) / n; 0.5 for a single feature."""
    r = (F.col("place") - 0.5) / F.col("total")
    return tied_places(scores, name).select("fid", F.when(F.col("total") <= 1, 0.5).otherwise(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))).alias(name))


def fuse(embedded: DataFrame, spectral: DataFrame, mu_e: float, mu_s: float) -> DataFrame:
    """(fid, score) of two rank-normalised scores."""
    both = embedded.select("fid", F.col("score").alias("e")).join(spectral.select("fid", F.col("score").alias("s")), "fid")
    return both.select("fid", choquet(F.col("e"), F.col("s"), F.lit(mu_e), F.lit(mu_s)).alias("score"))


def fuse_grid(embedded: DataFrame, spectral: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """(mu_e, mu_s, fid, score) for every pair of capacities of the grid, which is a parameter and small."""
    both = embedded.select("fid", F.col("score").alias("e")).join(spectral.select("fid", F.col("score").alias("s")), "fid")
    values = F.array(*map(F.lit, grid))
    pairs = both.select("fid", "e", "s", F.explode(values).alias("mu_e")).select("*", F.explode(values).alias("mu_s"))
    return pairs.select("mu_e", "mu_s", "fid", choquet(F.col("e"), F.col("s"), F.col("mu_e"), F.col("mu_s")).alias("score"))


def ranking(scores: DataFrame, top_k: int | None = None) -> DataFrame:
    """(rank, fid, score): best first (all, or ``top_k``), ties to the smaller feature; ranks and feature numbers count from 1."""
    ranked = places(scores).select((F.col("place") + 1).cast("int").alias("rank"), (F.col("fid") + 1).alias("fid"), "score")
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def n_selected(d: int, p_frac: float) -> int:
    """How many features a share is; halves round to even."""
    return max(1, round(p_frac * d))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """(fid, score) of the k best, ties to the smaller feature."""
    return places(scores).where(F.col("place") < k).select("fid", "score")


def best_capacities(grid_scores: DataFrame) -> DataFrame:
    """One row (mu_e, mu_s, gm): the greatest gm, the first in grid order if tied; no row if there is none above -1 (the caller then takes 0.5, 0.5)."""
    return grid_scores.select("mu_e", "mu_s", "gm").where("gm > -1").orderBy(F.desc("gm"), "mu_e", "mu_s").limit(1)
