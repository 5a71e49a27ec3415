"""Regression by definition as pure Catalyst plans, for short chains.

With G distinct covariates these plans hold G*G/2 interval rows a threshold,
so they are for G up to a few dozen; the kernels take over beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _min_max(intervals: DataFrame, keys: list[str], decreasing: bool) -> DataFrame:
    """keys, i, f from intervals (keys, r, s, v): over r <= i of over s >= i, in two windows.

    The suffix extreme over s is a window; at each s = i it is the value over
    all s >= i, which the outer aggregate combines over r.
    """
    inner, outer = (F.max, F.min) if decreasing else (F.min, F.max)
    after = Window.partitionBy(*keys, "r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    m = intervals.withColumn("m", inner("v").over(after))
    return m.groupBy(*keys, F.col("s").alias("i")).agg(outer("m").alias("f"))


def chain(points: DataFrame, keys: list[str], decreasing: bool) -> DataFrame:
    """keys, x, fitted from points (keys, x, w, n): the monotone fit of n / w over x."""
    order = Window.partitionBy(*keys).orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    p = points.select(*keys, "x", "w", "n", F.row_number().over(order).alias("i"), F.sum("n").over(upto).alias("cn"), F.sum("w").over(upto).alias("cw"))
    part = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # every s with the list of starts before it: a bounded array instead of a self-join
    starts = p.withColumn("starts", F.collect_list(F.struct(F.col("i").alias("r"), (F.col("cn") - F.col("n")).alias("n0"), (F.col("cw") - F.col("w")).alias("w0"))).over(part))
    intervals = starts.select(*keys, F.col("i").alias("s"), "cn", "cw", F.explode("starts").alias("a")).select(
        *keys, F.col("a.r").alias("r"), "s", ((F.col("cn") - F.col("a.n0")) / (F.col("cw") - F.col("a.w0"))).alias("v"))
    fits = _min_max(intervals, keys, decreasing)
    return p.select(*keys, "x", "i").join(fits, [*keys, "i"]).select(*keys, "x", F.col("f").alias("fitted"))


def threshold_counts(obs: DataFrame, by: list[str], grid: list[float] | None = None) -> DataFrame:
    """by..., threshold, x, w, n: weight of each covariate and its part at or below each threshold.

    Sums by (x, y) are completed to all pairs with zeros and added up along y.
    """
    cov = obs.groupBy(*by, "x").agg(F.sum("w").alias("w"))
    if grid is None:
        zs = obs.groupBy(*by).agg(F.collect_set("y").alias("zs"))
    else:
        zs = obs.groupBy(*by).agg(F.array_union(F.collect_set("y"), F.array(*[F.lit(float(z)) for z in grid])).alias("zs"))
    all_pairs = (cov.join(zs, by) if by else cov.crossJoin(zs)).select(*by, "x", "w", F.explode("zs").alias("threshold"))
    sums = obs.groupBy(*by, "x", F.col("y").alias("threshold")).agg(F.sum("w").alias("m"))
    upto = Window.partitionBy(*by, "x").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    out = all_pairs.join(sums, [*by, "x", "threshold"], "left").select(*by, "threshold", "x", "w", F.sum(F.coalesce("m", F.lit(0.0))).over(upto).alias("n"))
    return out if grid is None else out.where(F.col("threshold").isin([float(z) for z in grid]))


def idr_chain(obs: DataFrame, by: list[str], increasing: bool = True, grid: list[float] | None = None) -> DataFrame:
    """by..., x, threshold, cdf of aggregated observations (by..., x, y, w)."""
    return chain(threshold_counts(obs, by, grid), [*by, "threshold"], increasing).select(*by, "x", "threshold", F.col("fitted").alias("cdf"))
