"""Parameters of the plans, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

SIMILARITIES = ("jaccard", "cosine", "hamming")


@dataclass(frozen=True)
class RarityParams:
    gamma: float = 2.0
    kappa: float = 1.5
    s_max: float = 3.0


@dataclass(frozen=True)
class EmbeddedParams:
    rank: int = 50
    label_gamma: float = 0.0
    alpha: float = 0.35
    max_iter: int = 120
    tol: float = 1e-6
    beta: float = 0.01
    rho: float = 1e-4
    use_instance_weights: bool = True
    inst: RarityParams = field(default_factory=RarityParams)
    seed: int = 0
    power_iter: int = 25

    def __post_init__(self) -> None:
        if self.max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if isinstance(self.inst, dict):
            object.__setattr__(self, "inst", RarityParams(**self.inst))
        object.__setattr__(self, "alpha", min(max(float(self.alpha), 0.0), 1.0))


@dataclass(frozen=True)
class SpectralParams:
    alpha: float = 0.50
    label_sim: str = "jaccard"
    label_knn: int = 0
    label_self_loops: bool = False
    instance_weight_gamma: float = 0.0

    def __post_init__(self) -> None:
        if self.label_sim not in SIMILARITIES:
            raise ValueError(f"label_sim must be one of {SIMILARITIES}")


@dataclass(frozen=True)
class MlknnParams:
    k: int = 10
    s: float = 1.0
    label_adaptive_k: bool = False
    label_k_min: int = 3
    label_k_power: float = 0.5

    def __post_init__(self) -> None:
        if self.k < 1 or self.s <= 0:
            raise ValueError("k and s must be positive")
        if self.label_k_min > self.k:
            raise ValueError("label_k_min must not exceed k")


@dataclass(frozen=True)
class SelectionParams:
    p_frac: float = 0.20
    cv: int = 3
    grid: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    mlknn_k: int = 10
    seed: int = 42


def params_of(kind: type, given):
    """None, a dict or an instance, as an instance."""
    return kind() if given is None else kind(**given) if isinstance(given, dict) else given


# The named variants as (alpha, instance weights, all stages).
VARIANTS = {
    "full": (0.35, True, True),
    "embedded": (0.35, True, False),
    "regression": (0.0, True, False),
    "logistic": (1.0, True, False),
    "unweighted": (0.35, False, False),
    "simple": (0.0, False, False),
}
