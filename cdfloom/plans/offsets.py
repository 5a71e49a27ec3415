"""Global offsets: prefix sums over a whole table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(df: DataFrame, columns: list[str], size: str, name: str, buckets: int = 4096) -> DataFrame:
    """`df` with column `name`: the sum of `size` over the rows before it, in an order that only `columns` decide; they must tell rows apart.

    Rows are dealt to buckets by a hash: windows see one bucket each, and the one
    window that sees all has a row a bucket.
    """
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    totals = rows.groupBy("__bucket").agg(F.sum(size).alias("__sum"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(starts, "__bucket")
    return placed.withColumn(name, F.col("__before") + F.col("__in")).drop("__bucket", "__in", "__before")
