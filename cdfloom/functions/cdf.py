"""Queries on a CDF given by arrays: `cdf` (values) at `thresholds` (ascending)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Averages and blends of CDFs are off by rounding; equality and "reaches 1" allow this much.
TOLERANCE = 1e-12


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def blend(left: Column, right: Column, share: Column) -> Column:
    """(1 - share) * left + share * right, elementwise."""
    return F.when(share == 0, left).otherwise(F.zip_with(left, right, lambda a, b: (1 - share) * a + share * b))


def position(thresholds: Column, y: Column) -> Column:
    """Number of thresholds at or below y: the as-of position."""
    return F.size(F.filter(thresholds, lambda z: z <= y))


def cdf_at(cdf: Column, thresholds: Column, y: Column) -> Column:
    """F(y); 0 below the first threshold; null for a null y."""
    return F.when(y.isNotNull(), let(position(thresholds, y), lambda k: F.when(k == 0, F.lit(0.0)).otherwise(F.get(cdf, k - 1))))


def cdf_before(cdf: Column, thresholds: Column, y: Column) -> Column:
    """The left limit F(y-)."""
    k = F.size(F.filter(thresholds, lambda z: z < y))
    return F.when(y.isNotNull(), let(k, lambda k: F.when(k == 0, F.lit(0.0)).otherwise(F.get(cdf, k - 1))))


def steps(cdf: Column) -> Column:
    """Jumps of the CDF."""
    return F.zip_with(cdf, F.concat(F.array(F.lit(0.0)), F.slice(cdf, 1, F.greatest(F.size(cdf) - 1, F.lit(0)))), lambda a, b: a - b)


def mean(cdf: Column, thresholds: Column) -> Column:
    """Expectation; null if the CDF does not reach 1 (mass lost to censoring)."""
    total = F.aggregate(F.zip_with(steps(cdf), thresholds, lambda w, z: w * z), F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(cdf) > 0) & (F.get(cdf, F.size(cdf) - 1) >= 1 - TOLERANCE), total)


def quantile(cdf: Column, thresholds: Column, p: Column, upper: bool = False) -> Column:
    """Lower quantile: the first threshold with F >= p (p = 0: with F > 0).  Upper: see below.  Infinity if there is none.

    Upper: behind the last threshold with F equal to p (the last threshold, if
    nothing is behind), else the first with F > p.
    """
    inf = F.lit(float("inf"))
    pick = lambda test: F.get(F.transform(F.filter(F.arrays_zip(cdf.alias("c"), thresholds.alias("z")), lambda s: test(s["c"])), lambda s: s["z"]), F.lit(0))
    if not upper:
        return F.when(p == 0, F.coalesce(pick(lambda c: c > TOLERANCE), inf)).otherwise(F.coalesce(pick(lambda c: c >= p - TOLERANCE), inf))
    equal = F.size(F.filter(cdf, lambda c: c <= p + TOLERANCE))  # thresholds up to the last equal one
    has = F.exists(cdf, lambda c: F.abs(c - p) <= TOLERANCE)
    behind = F.get(thresholds, F.least(equal, F.size(thresholds) - 1))
    return F.when(has, behind).otherwise(F.coalesce(pick(lambda c: c > p + TOLERANCE), inf))
