"""Verification scores, for fitted CDFs and for raw ensembles (an array of members)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cdf import cdf_at, cdf_before, let, steps


def quantile_score(forecast: Column, p: Column | float, y: Column) -> Column:
    p = F.lit(p) if isinstance(p, float) else p
    return 2 * (F.when(forecast > y, 1.0).otherwise(0.0) - p) * (forecast - y)


def brier_score(probability: Column, z: Column, y: Column) -> Column:
    """Of the forecast P(Y <= z)."""
    return F.pow(probability - F.when(y <= z, 1.0).otherwise(0.0), F.lit(2.0))


def crps(cdf: Column, thresholds: Column, y: Column) -> Column:
    """Continuous ranked probability score of a step CDF."""
    parts = F.zip_with(F.zip_with(steps(cdf), cdf, lambda w, c: F.struct(w.alias("w"), c.alias("c"))), thresholds,
                       lambda s, z: s["w"] * (F.when(y < z, 1.0).otherwise(0.0) - s["c"] + s["w"] / 2) * (z - y))
    return 2 * F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def pit(cdf: Column, thresholds: Column, y: Column, seed: int | None = None) -> Column:
    """F(y); with a seed, uniform in [F(y-), F(y)]."""
    at = cdf_at(cdf, thresholds, y)
    if seed is None:
        return at
    before = cdf_before(cdf, thresholds, y)
    return before + F.rand(seed) * (at - before)


# ---- raw ensembles ----

def ensemble_cdf(members: Column, z: Column) -> Column:
    return F.size(F.filter(members, lambda m: m <= z)) / F.size(members)


def ensemble_quantile(members: Column, p: Column) -> Column:
    """Inverse of the empirical CDF (type 1)."""
    k = F.greatest(F.lit(1), F.ceil(p * F.size(members) - 1e-12).cast("int"))
    return F.get(F.sort_array(members), k - 1)


def ensemble_crps(members: Column, y: Column) -> Column:
    m = F.size(members)
    return let(F.sort_array(members), lambda s: 2 / m * F.aggregate(
        F.transform(s, lambda x, k: (F.when(y < x, 1.0).otherwise(0.0) - (k + 0.5) / m) * (x - y)), F.lit(0.0), lambda a, b: a + b))


def ensemble_pit(members: Column, y: Column, seed: int | None = None) -> Column:
    at = ensemble_cdf(members, y)
    if seed is None:
        return at
    before = F.size(F.filter(members, lambda m: m < y)) / F.size(members)
    return before + F.rand(seed) * (at - before)
