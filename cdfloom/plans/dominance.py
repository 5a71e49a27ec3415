"""Dominance between points as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OrderMismatch
from .lineage import cut


def at_most(a: Column, b: Column) -> Column:
    """Componentwise a <= b of two arrays of one length."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda t: t)


def dominance_pairs(points: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """lo, hi: ids of points where lo is at most hi in every column, and they differ.

    The result may have any number of pairs up to all; the work beyond them is
    bounded: points are cut into ranges of the first column, and two ranges meet
    in an equi-join on the later one's number only where the earlier is not
    after it, so tasks hold parts of a range each, and no join is a nested loop
    over whole tables.
    """
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = columns[0]
    bounds = sorted(set(points.stat.approxQuantile(first, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    # n - 1 bounds from the session's setting: few
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(first))) if bounds else F.lit(0)
    rows = points.select(F.col(id_col).alias("__id"), *columns).withColumn("__r", part)
    last = len(bounds)
    lo = rows.select(F.col("__id").alias("lo"), *[F.col(c).alias(f"__a{i}") for i, c in enumerate(columns)], F.explode(F.sequence("__r", F.lit(last))).alias("__r"))
    hi = rows.select(F.col("__id").alias("hi"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(columns)], "__r")
    le, lt = F.lit(True), F.lit(False)
    for i in range(len(columns)):
        le = le & (F.col(f"__a{i}") <= F.col(f"__b{i}"))
        lt = lt | (F.col(f"__a{i}") < F.col(f"__b{i}"))
    return lo.join(hi, "__r").where(le & lt).select("lo", "hi")


def cover_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of a closed relation (lo, hi) with nothing between: its transitive reduction."""
    a, b = pairs.alias("a"), pairs.alias("b")
    two_steps = a.join(b, F.col("a.hi") == F.col("b.lo")).select(F.col("a.lo").alias("lo"), F.col("b.hi").alias("hi")).distinct()
    return pairs.join(two_steps, ["lo", "hi"], "left_anti")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs (lo, hi) reachable over the edges, by joining paths with themselves until nothing is new.

    Each round doubles the length of the paths that are known, so the rounds are
    as many as the longest path's length has binary digits.
    """
    known = cut(edges.select("lo", "hi").where("lo != hi").distinct())
    size = known.count()
    while True:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.hi") == F.col("b.lo")).select(F.col("a.lo").alias("lo"), F.col("b.hi").alias("hi"))
        known = cut(known.unionByName(longer).distinct())
        now = known.count()
        if now == size:
            return known
        size = now


def topological_order(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id_col, rank: the number of nodes before it; of two nodes on an edge (lo, hi) the first has the smaller rank.

    Nodes of one rank are not comparable.  A cycle, which has no such order, raises OrderMismatch.
    """
    closed = transitive_closure(edges)
    a, b = closed.alias("a"), closed.alias("b")
    if not a.join(b, (F.col("a.lo") == F.col("b.hi")) & (F.col("a.hi") == F.col("b.lo"))).isEmpty():
        raise OrderMismatch("the relation has a cycle")
    before = closed.groupBy(F.col("hi").alias("__n")).agg(F.count("*").alias("__k"))
    joined = nodes.select(id_col).distinct().join(before, F.col(id_col) == F.col("__n"), "left")
    return joined.select(id_col, F.coalesce("__k", F.lit(0)).alias("rank"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, below, above: sorted ids of the nodes that an edge (lo, hi) joins to it from below and to above."""
    up = edges.select(F.col("lo").alias("node"), F.col("hi").alias("x"), F.lit(True).alias("up"))
    down = edges.select(F.col("hi").alias("node"), F.col("lo").alias("x"), F.lit(False).alias("up"))
    listed = lambda flag: F.sort_array(F.collect_set(F.when(F.col("up") == flag, F.col("x"))))
    return up.unionByName(down).groupBy("node").agg(listed(False).alias("below"), listed(True).alias("above"))


def extremes(edges: DataFrame, nodes: DataFrame, id_col: str, minimal: bool = True) -> DataFrame:
    """The nodes that nothing precedes (minimal), or that precede nothing."""
    other = edges.select(F.col("hi" if minimal else "lo").alias(id_col)).distinct()
    return nodes.join(other, id_col, "left_anti")
