"""As-of join: for each left row the last right key at or before it and the first at or after it.

The left side is range-partitioned by its own quantiles; a slice of the right
side, and the nearest right key outside on each side, goes with each range, so
neither side is collected and no task gets more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_both(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """`left` with below (largest right `on` <= it) and above (smallest >= it); null where there is none.

    `right` must have the columns by... and `on`.  Rows of a null `on` get nulls.
    """
    by = by or []
    k = ranges or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(left.stat.approxQuantile(on, [i / k for i in range(1, k)], 0.25 / k))) if k > 1 else []
    cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else None
    # k - 1 bounds from the session's setting: few
    part = lambda: F.size(F.filter(cuts, lambda b: b <= F.col(on))) if bounds else F.lit(0)
    keys = right.select(*by, on).distinct().withColumn("__r", part())
    edges = keys.groupBy(*by, "__r").agg(F.min(on).alias("lo"), F.max(on).alias("hi"))
    groups = keys.select(*by).distinct() if by else left.sparkSession.range(1).select()
    every = groups.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    across = Window.partitionBy(*by).orderBy("__r")
    carried = every.join(edges, [*by, "__r"], "left").select(
        *by, "__r",
        F.last("hi", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("lo", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    outside = carried.select(*by, "__r", F.explode(F.array("before", "after")).alias(on)).where(F.col(on).isNotNull())
    marks = keys.select(*by, "__r", on).unionByName(outside).select(*by, "__r", F.col(on).alias("__k"), F.col(on).alias("__v"), F.lit(None).cast(_row_type(left)).alias("__row"))
    rows = left.select(*by, part().alias("__r"), F.col(on).alias("__k"), F.lit(None).cast("double").alias("__v"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    inside = Window.partitionBy(*by, "__r").orderBy("__k")  # peers share a frame
    both = marks.unionByName(rows).select(
        "__row", "__k",
        F.last("__v", True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("below"),
        F.first("__v", True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("above"))
    known = F.col("__k").isNotNull()
    return both.where(F.col("__row").isNotNull()).select("__row.*", F.when(known, F.col("below")).alias("below"), F.when(known, F.col("above")).alias("above"))


def _row_type(df: DataFrame):
    return df.schema
