"""Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarized(labels: Column) -> Column:
    """Labels in {0, 1} from {0, 1} or {-1, 1}."""
    return F.transform(labels, lambda v: (v > 0).cast("tinyint"))


def pattern(labels: Column) -> Column:
    """A row's label pattern as a string of bits, for any number of labels."""
    return F.array_join(F.transform(labels, lambda v: F.when(v > 0, "1").otherwise("0")), "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v over its length; the length is an argument of the lambda, so that it is taken once a row and not once a component."""
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(least))), lambda length: F.transform(v, lambda x: x / length)), F.lit(0))


def scaled(v: Column, weight: Column) -> Column:
    return F.transform(v, lambda x: x * weight)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logistic_loss(z: Column, y: Column) -> Column:
    """log(1 + e^z) - y z without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def choquet(e: Column, s: Column, mu_e: Column, mu_s: Column) -> Column:
    """The two-source Choquet integral with capacities mu_e and mu_s."""
    return F.when(e >= s, s + (e - s) * mu_e).otherwise(e + (s - e) * mu_s)


def interaction(mu_e: Column, mu_s: Column) -> Column:
    return 1 - mu_e - mu_s
