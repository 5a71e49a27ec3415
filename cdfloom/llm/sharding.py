"""Balanced contiguous sharding by global byte-size prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

LAW = "bytes"


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """Assign every row to one of `shards` contiguous runs of nearly equal bytes.

    Rows are range-partitioned by id; each partition adds up its sizes; the
    exclusive prefix sum over the (few) partition totals gives every row its
    global byte offset, and shard k takes the rows whose midpoint falls into
    the k-th equal cut of the total.  No task sees more than one partition.

    Returns id, size (UTF-8 bytes plus `row_overhead`), text_crc32 (unsigned),
    law, shard, slot (gapless from 0 in id order), grown_shard (null: this law
    does not promise stability when a shard is added).

    A null text has size `row_overhead` and the CRC of nothing (0).  Null ids
    sort first; equal ids are ordered by CRC and size, and rows equal in all of
    these are interchangeable, so the result is the same on a rerun.  Hot ids
    are split by a salt.  An empty table gives an empty result.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    text = F.col(f"`{text_col}`")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        # rows that are equal in id, CRC and size are dealt out by where they were read
        (F.monotonically_increasing_id() % 1009).alias("salt"),
    )
    ranged = sized.repartitionByRange(n, "id", "crc", "size", "salt").withColumn("part", F.spark_partition_id())
    rows = materialize(ranged, "shard-rows")

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
        F.sum("b").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("id", "crc", "size", "salt")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.withColumn("before", before)
        .withColumn("nth", F.row_number().over(inside))
        .join(starts, "part")
        .select(
            "id", "size", "crc",
            (F.col("c0") + F.col("nth")).alias("g"),
            F.expr(f"cast(((2 * (b0 + before) + size) * {shards}) div (2 * total) as int)").alias("shard"),
        )
    )
    placed = materialize(placed, "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("g").alias("g0"))
    return placed.join(F.broadcast(firsts), "shard").select(  # `shards` rows at most
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", (F.col("g") - F.col("g0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
