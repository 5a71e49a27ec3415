"""Mixing sources to target weights with blocks, multinomial draws and index permutations.

The words of each source, in id order, are packed into blocks of a fixed
length.  Every output shard draws how many of its slots each source gets
(multinomial over what is still owed).  The k-th slot of a source takes block
pi(k mod B) of its B blocks, pi being a keyed pseudorandom permutation of
0..B-1 that is computed by arithmetic alone, so slots and blocks meet by an
equi-join on (source, block) and nothing is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, shuffle_partitions, words_of
from .shingles import U
from .shingles import mix as scramble

#: Sources are settings, each with its weight; their table and draws go through the driver: about 1 KB a source.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """weights: repeated over the sources in code point order, null last.
    total: words of the mix as a multiple of all words.  max_epochs: how often a
    word may be taken.  block_words: length of a block; a source of fewer than
    least_blocks such blocks has shorter ones, so that its share, a whole number
    of blocks, comes near its target.  shards: output shards.  seed: of draws
    and permutations.  rounds: of the permutation.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    max_epochs: int = 2
    block_words: int = 128
    least_blocks: int = 64
    shards: int = 64
    seed: int = 17
    rounds: int = 24

    def block_length(self, source_size: int) -> int:
        return min(self.block_words, max(1, source_size // self.least_blocks))


def word_count(text: Column) -> Column:
    """Words of a text: white-space runs inside the trimmed text plus one; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words each source owes the mix: by weight, none above max_epochs times its size."""
    total = mix.total * sum(sizes)
    weight = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weight[i] for i in free)
        share = {i: left * weight[i] / w for i in free}
        over = [i for i in free if share[i] > mix.max_epochs * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: float(mix.max_epochs * sizes[i]) for i in over}


def draw_counts(owed: list[int], mix: Mix) -> np.ndarray:
    """Slots by shard and source: each shard draws from what is still owed; the last takes the rest."""
    rng = np.random.default_rng(mix.seed)
    left = np.array(owed, np.int64)
    out = np.zeros((mix.shards, len(owed)), np.int64)
    for s in range(mix.shards):
        shards_left = mix.shards - s
        if shards_left == 1 or not left.sum():
            out[s] = left
        else:
            drawn = rng.multinomial(left.sum() // shards_left, left / left.sum())
            out[s] = np.minimum(drawn, left)
        left = left - out[s]
    return out


def permuted(index: np.ndarray, size: int, key: np.ndarray, rounds: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1, each index under its key: the swap-or-not shuffle (Hoang, Morris
    and Rogaway, 2012).

    Each round pairs x with (k - x) mod size and swaps the two or not by a hash
    of the larger; both sides of a pair decide alike, so any size is permuted.
    """
    x, n = index.astype(np.uint64), U(size)
    for r in range(1, rounds + 1):
        salted = scramble(key, r)
        partner = (salted % n + n - x) % n
        swap = (scramble(np.maximum(x, partner) ^ salted, r) & U(1)).astype(bool)
        x = np.where(swap, partner, x)
    return x.astype(np.int64)


RUN = 1 << 14  # slots of one row of the plan


def _slots(drawn: DataFrame, mix: Mix, partitions: int) -> DataFrame:
    """shard, position, sid, block from a row a shard and source: cut into runs of bounded length, numbered and permuted in numpy."""
    runs = drawn.withColumn("r", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))).repartition(partitions)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                j = np.arange(row["r"] * RUN, min((row["r"] + 1) * RUN, row["n"]))
                k = row["slot0"] + j
                key = scramble((k // row["blocks"]).astype(np.uint64), mix.seed * 1_000_003 + row["sid"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), row["shard"], np.int32)), pa.array(row["place0"] + j), pa.array(np.full(len(j), row["sid"], np.int32)),
                     pa.array(permuted(k % row["blocks"], row["blocks"], key, mix.rounds))], names=["shard", "position", "sid", "block"])

    return runs.select("sid", "blocks", "shard", "n", "slot0", "place0", "r").mapInArrow(number, "shard int, position long, sid int, block long")


@dataclass
class Mixed:
    """docs: id, size, source_size, target.  slots: shard, position, source, block.
    pieces: which words of which document lie in which block."""

    docs: DataFrame
    slots: DataFrame
    pieces: DataFrame


def plan_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None, keep: tuple[str, ...] = ()) -> Mixed:
    """Plan a mix of all `docs`.

    Word offsets are prefix sums over range partitions by source and id: only
    the partition totals are summed up by source, so a hot source is spread
    over many tasks.  Null ids sort first; rows equal in source, id and size
    share their offsets' order by text hash, and rows equal in that too are
    interchangeable.  Documents without words get no piece and no share.  An
    empty table gives an empty mix.  The plan's docs carry the columns `keep`
    along; others are not read.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    text = docs[f"`{text_col}`"]
    sized = docs.select(
        docs[f"`{source_col}`"].alias("source"), docs[f"`{id_col}`"].alias("id"),
        word_count(text).alias("size"), F.xxhash64(text).alias("h"),
        (F.monotonically_increasing_id() % 1009).alias("salt"), *[docs[f"`{c}`"] for c in keep],
    )
    order = ["source", "id", "h", "salt"]
    # range partitioning samples its input first: the texts are read and counted once, before
    sized = materialize(sized, "mix-sizes")
    rows = materialize(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-rows")

    totals = rows.groupBy("source", "part").agg(F.sum("size").alias("b"))  # a row a source and partition at most
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"))

    sources = totals.groupBy("source").agg(F.sum("b").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name sources more coarsely")
    # str compares by code point
    sources = sorted(((r["source"], r["source_size"]) for r in sources), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [size for _, size in sources]
    wanted = targets(sizes, mix) if sources else []
    lengths = [mix.block_length(size) for size in sizes]
    blocks = [-(-size // length) for size, length in zip(sizes, lengths)]
    owed = [min(mix.max_epochs * b, round(t * b / size)) if size else 0 for t, b, size in zip(wanted, blocks, sizes)]
    counts = draw_counts(owed, mix) if sources else np.zeros((0, 0), np.int64)
    first_slot = np.cumsum(counts, axis=0) - counts
    first_place = np.cumsum(counts, axis=1) - counts

    source_rows = spark.createDataFrame(
        [(i, s, size, float(t), length) for i, ((s, size), t, length) in enumerate(zip(sources, wanted, lengths))],
        "sid int, source string, source_size long, target double, length long")
    # a row a source, with its counts by shard
    drawn = spark.createDataFrame(
        [(i, blocks[i], counts[:, i].tolist(), first_slot[:, i].tolist(), first_place[:, i].tolist()) for i in range(counts.shape[1])],
        "sid int, blocks long, n array<long>, slot0 array<long>, place0 array<long>")
    drawn = drawn.select("sid", "blocks", F.posexplode(F.arrays_zip("n", "slot0", "place0")).alias("shard", "d")).select("sid", "blocks", "shard", "d.*").where("n > 0")
    slots = _slots(drawn, mix, n)

    inside = Window.partitionBy("source", "part").orderBy("id", "h", "salt").rowsBetween(Window.unboundedPreceding, -1)
    known = source_rows.select(F.col("source").alias("__s"), "sid", "source_size", "target", "length")
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts.select(F.col("source").alias("__s0"), F.col("part").alias("__p0"), "b0"),
              F.col("source").eqNullSafe(F.col("__s0")) & (F.col("part") == F.col("__p0")))
        .join(known, F.col("source").eqNullSafe(F.col("__s")))
        .select("id", "h", "salt", "part", "source", "sid", "size", "source_size", "target", "length", (F.col("b0") + F.col("inside")).alias("offset"), *keep)
    )
    placed = materialize(placed, "mix-placed")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr("sequence(offset div length, (offset + size - 1) div length)")))
    pieces = pieces.select(
        "sid", "block", "id", "offset",
        F.greatest(F.col("block") * F.col("length"), F.col("offset")).alias("lo"),
        F.least((F.col("block") + 1) * F.col("length"), F.col("offset") + F.col("size")).alias("hi"))
    return Mixed(placed, slots, pieces)


def taken_words(mixed: Mixed, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents with `taken`: how many of their words, repeats counted, the mix takes; and the plan's columns `keep`.

    (source, offset) names a document with words: two never start at one word.
    """
    times = mixed.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = (
        mixed.pieces.join(times, ["sid", "block"])
        .groupBy("sid", "offset").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    )
    some = mixed.docs.where("size > 0").join(taken, ["sid", "offset"], "left")
    none = mixed.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), *keep]
    return some.select(*cols).unionAll(none.select(*cols))


def mixed_text(docs: DataFrame, mixed: Mixed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: shard, position, source number and the block's words joined by a space.

    `docs` must be the planned table, with unique ids.
    """
    words = docs.select(docs[f"`{id_col}`"].alias("id"), words_of(docs[f"`{text_col}`"]).alias("w"))
    cut = (
        mixed.pieces.join(words, "id")
        .select("sid", "block", "lo", F.array_join(F.slice("w", (F.col("lo") - F.col("offset") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ").alias("piece"))
        .groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "piece"))).alias("p"))  # block_words pieces at most
        .select("sid", "block", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
    )
    return mixed.slots.join(cut, ["sid", "block"]).select("shard", "position", F.col("sid").alias("source_number"), "text")
