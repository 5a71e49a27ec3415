"""Subsampled IDR: fit, then the averaged CDF of new data in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cdf as C
from ..model import fit_idr


def idr_bag(df: DataFrame, y: str, x: str | list[str], newdata: DataFrame, subsamples: int, subsample_size: int | float | None = None, replace: bool = False, seed: int = 0, grid: list[float] | None = None, **options) -> DataFrame:
    """`newdata` with thresholds and cdf, averaged over subsamples; with a `grid`, at its points."""
    model = fit_idr(df, y, x, subsamples=subsamples, subsample_size=subsample_size, replace=replace, seed=seed, **options)
    out = model.predict_cdf(newdata)
    if grid is None:
        return out
    points = F.array(*[F.lit(float(z)) for z in sorted(grid)])
    at = F.transform(points, lambda z: C.cdf_at(F.col("cdf"), F.col("thresholds"), z))
    return out.withColumn("cdf", at).withColumn("thresholds", points)
