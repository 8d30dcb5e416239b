"""From samples to one ranking of their features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.evaluate import select_capacities
from rankweave.operators.fusion import fuse, rank_uniform, ranking
from rankweave.operators.solver import fit_embedded
from rankweave.operators.spectral import spectral_scores
from rankweave.plans.params import VARIANTS, EmbeddedParams, SelectionParams, SpectralParams, params_of


def rank_features(samples: DataFrame, variant: str = "full", embedded: EmbeddedParams | dict | None = None, spectral: SpectralParams | dict | None = None, selection: SelectionParams | dict | None = None, top_k: int | None = None) -> tuple[DataFrame, dict]:
    """(rank, fid, score) by one of the named variants, all or the ``top_k`` first, and a dict of what was found."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {sorted(VARIANTS)}")
    alpha, weights, full = VARIANTS[variant]
    first, facts = fit_embedded(samples, replace(params_of(EmbeddedParams, embedded), alpha=alpha, use_instance_weights=weights))
    if not full:
        return first if top_k is None else first.where(F.col("rank") <= top_k), {"variant": variant, "embedded": facts}
    of_embedded = first.select((F.col("fid") - 1).alias("fid"), "score")
    of_spectral = spectral_scores(samples, spectral if spectral is not None else SpectralParams(alpha=0.70)).select("fid", "score")
    e, s = rank_uniform(of_embedded), rank_uniform(of_spectral)
    mu_e, mu_s, gm = select_capacities(samples, e, s, selection)
    return ranking(fuse(e, s, mu_e, mu_s), top_k), {"variant": variant, "embedded": facts, "mu_e": mu_e, "mu_s": mu_s, "interaction": 1 - mu_e - mu_s, "gm": gm}
