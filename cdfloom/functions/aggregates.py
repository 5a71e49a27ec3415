"""Aggregates: as plain columns where sums do, as grouped Arrow functions where order is needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..kernels import functionals


def weighted_average(y: Column, w: Column) -> Column:
    return F.sum(w * y) / F.sum(w)


def weighted_variance(y: Column, w: Column) -> Column:
    """Reliability weights; null for fewer than two rows.  From sums alone, so it combines on the map side."""
    sw, swy, swyy, sww = F.sum(w), F.sum(w * y), F.sum(w * y * y), F.sum(w * w)
    return F.when(F.count(y) >= 2, (swyy - swy * swy / sw) / (sw - sww / sw))


def expected_shortfall(df: DataFrame, y: str, alpha: float, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., expected_shortfall: mean of the lower `alpha` mass; null for fewer than ceil(1/alpha) rows.

    Equal values are added up first; the running mass is a window over distinct values.
    """
    import math

    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mass = df.groupBy(*by, F.col(y).cast("double").alias("__y")).agg(F.sum(w).alias("__m"), F.count("*").alias("__k"))
    part = Window.partitionBy(*by)
    upto = F.sum("__m").over(part.orderBy("__y").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m")
    cut = F.lit(alpha) * F.sum("__m").over(part)
    used = mass.withColumn("__cut", cut).withColumn("__u", F.least(F.col("__m"), F.greatest(cut - upto, F.lit(0.0))))
    out = used.groupBy(*by).agg((F.sum(F.col("__u") * F.col("__y")) / F.max("__cut")).alias("v"), F.sum("__k").alias("k"))
    return out.select(*by, F.when(F.col("k") >= math.ceil(1 / alpha), F.col("v")).alias("expected_shortfall"))


@F.pandas_udf(DoubleType())
def variance(y: pd.Series, w: pd.Series) -> float:
    """Grouped: the reliability-weighted variance as a plug-in for any group."""
    return functionals.variance(functionals.Rows.of(y.to_numpy(), None, w.to_numpy()))


def order_statistic(df: DataFrame, y: str, k: int, by: list[str] | None = None) -> DataFrame:
    """by..., value: the k-th smallest (from 1)."""
    by = by or []
    counts = df.groupBy(*by, F.col(y).alias("value")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("__u", upto).where((F.col("__u") >= k) & (F.col("__u") - F.col("__c") < k)).select(*by, "value")
