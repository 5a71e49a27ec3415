"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v): neighbours move to the smallest one in reach.

    The smallest neighbour is an aggregate, joined back: no node's neighbours
    are ever gathered, so a hub is no hot task beyond what a skewed join splits.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u != v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionAll(own).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected `edges` (u, v), for nodes with an edge.

    Rounds go on until nothing changes; a path of n nodes takes about log2(n) of them.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        older, now = now, materialize(_star(_star(now, True), False), "edges")
        discard(older)
        # decimals: the sums of hashes can't overflow
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v"), F.col("v")).distinct())
        before = state
