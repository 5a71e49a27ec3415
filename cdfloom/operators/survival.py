"""Kaplan-Meier curves and the constrained survival fit over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import park
from .prep import Roles, plain, validate


def _steps(df: DataFrame, time: str, event: str, weight: str | None, by: list[str]) -> DataFrame:
    """by..., time, d (event weight), survival at every distinct time.

    Only sums by distinct time leave the scan; the running product is a window
    over those.  Where everyone at risk has the event, survival is 0 from there.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    dead = F.when(F.col(event).cast("boolean"), w).otherwise(0.0)
    sums = df.where(w > 0).groupBy(*by, F.col(time).alias("time")).agg(F.sum(dead).alias("d"), F.sum(w).alias("m"))
    part = Window.partitionBy(*by)
    risk = F.sum("m").over(part.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))
    steps = sums.withColumn("n", risk)
    last = F.col("d") >= F.col("n")
    log = F.when(~last, F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0)
    upto = part.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("survival", F.when(F.max(last.cast("int")).over(upto) == 1, 0.0).otherwise(F.exp(F.sum(log).over(upto))))


def kaplan_meier(df: DataFrame, time: str, event: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., time, survival at the distinct event times; time keeps its type."""
    by = by or []
    return _steps(df, time, event, weight, by).where("d > 0").select(*by, "time", "survival")


def kaplan_meier_at(df: DataFrame, time: str, event: str, threshold: float, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., cdf: the Kaplan-Meier CDF at `threshold`; 0 before the first event."""
    by = by or []
    upto = F.min(F.when(F.col("time") <= threshold, F.col("survival")))  # survival never rises
    return _steps(df, time, event, weight, by).groupBy(*by).agg((1 - F.coalesce(upto, F.lit(1.0))).alias("cdf"))


def fit_park(df: DataFrame, x: str, y: str, observed: str, centres: list[float] | None = None, epsilon: float = 1e-4, by: list[str] | None = None) -> DataFrame:
    """by..., center, time, cdf: ordered survival functions, cdf increasing with the center.

    Rows go to the nearest centre; equal rows travel as one with their number.  Without `centres` they are chosen from x.
    cdf is null where a group has nobody at risk.
    """
    by = by or []
    rows = plain(df, Roles(y, [x], observed, None, by))
    validate(rows, 1)
    # equal rows are counted on the map side: a task holds distinct values
    rows = rows.groupBy(*by, "x0", "y", "observed").agg(F.count("*").cast("double").alias("k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.array(sorted(centres)) if centres else park.default_centres(pdf["x0"].to_numpy(), pdf["k"].to_numpy())
        times, cdf = park.fit(pdf["x0"].to_numpy(), pdf["y"].to_numpy(), pdf["observed"].to_numpy(), at, epsilon, pdf["k"].to_numpy())
        out = pd.DataFrame({"center": np.repeat(at, len(times)), "time": np.tile(times, len(at)), "cdf": cdf.ravel()})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "center", "time", "cdf"]]

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], "center double", "time double", "cdf double"])
    grouped = rows.groupBy(*by) if by else rows.groupBy(F.lit(0).alias("__g"))
    return grouped.applyInPandas(fit, schema).withColumn("cdf", F.nanvl("cdf", F.lit(None).cast("double")))

