"""Training tables: reading, ordinal codes, and the survival view of an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ordinal(column: str, levels: list) -> Column:
    """Codes 1, 2, ... of ordered levels; null for others."""
    out = F.lit(None).cast("double")
    for i, level in enumerate(levels, 1):
        out = F.when(F.col(column) == level, float(i)).otherwise(out)
    return out


def event_gaps(events: DataFrame, horizon_hours: int = 48, buckets: int = 10) -> DataFrame:
    """user_id, event_id, x (user bucket), y (hours to the user's next event, at most the horizon), observed: false for the
    user's last event and for gaps beyond the horizon, which end there without an event."""
    until = events.agg(F.max("ts").alias("t1"))
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = events.select("user_id", "event_id", "ts", F.lead("ts").over(mine).alias("nx")).crossJoin(F.broadcast(until))  # one row
    seconds = F.unix_micros(F.coalesce("nx", "t1").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    hours = F.ceil(seconds / 3.6e9)
    return gaps.select(
        "user_id", "event_id",
        F.pmod("user_id", F.lit(buckets)).cast("double").alias("x"),
        F.least(hours, F.lit(horizon_hours)).cast("double").alias("y"),
        (F.col("nx").isNotNull() & (hours <= horizon_hours)).alias("observed"))
