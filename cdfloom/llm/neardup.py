"""MinHash near-dedup by chosen-path set similarity join (after Christiani and Pagh, 2017).

Sets of word shingles are joined by independent trees.  A node of a tree picks
coordinates of the minwise signature by its own name; members that agree in a
picked coordinate move to the same child.  Picking 1 / similarity coordinates
on average, a linked pair is expected to stay together once at every level.
Small nodes are compared exhaustively on 4-bit sketches; large ones branch on,
and what is still large at the last level is compared block by block, inside
tasks of bounded size.  Pairs that pass the sketch are confirmed on the full
shingle sets of whole texts.

Exact copies (equal sets) are one member from the start.  First rounds join up
groups cheaply, as in Boruvka's algorithm: in trees of two levels each node has
a pivot, and each member is linked to the one most alike of the pivots that it
meets.  Later trees then compare members of different components only, so a
group of n near copies never becomes n*n pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import grouped, sliced
from .common import bucketed, discard, materialize
from .components import components
from .shingles import MinHash, jaccard_counts, shingle_sets

COORDINATES = 64  # minwise hashes that nodes pick from
SIGNATURE = 256  # minwise hashes of the sketch, which keeps 4 bits of each in longs
SKETCH = [f"k{j}" for j in range(SIGNATURE // 16)]
NIBBLE = 0x1111111111111111


@dataclass(frozen=True)
class NearDup:
    """Link two texts if 100 * intersection >= percent * union of their `width`-word shingle sets.

    trees, max_levels, leaf, block_rows, block_bytes: of the chosen-path join.  first_rounds, first_trees:
    of the pass that links to pivots.  sketch_sigmas: a linked pair passes the
    sketch unless its agreement falls so many deviations below the mean.
    """

    width: int = 5
    percent: int = 80
    trees: int = 12
    first_rounds: int = 3
    first_trees: int = 8
    max_levels: int = 3
    leaf: int = 64
    block_rows: int = 2048
    block_bytes: int = 8 << 20
    sketch_sigmas: float = 4.6
    seed: int = 11

    def least_agreement(self) -> int:
        """Sketch positions, of SIGNATURE, in which a pair must agree."""
        p = self.percent / 100
        p += (1 - p) / 16
        return max(0, math.floor(SIGNATURE * p - self.sketch_sigmas * math.sqrt(SIGNATURE * p * (1 - p))))

    def miss_probability(self) -> float:
        """Bound on losing a pair at the threshold in all trees that end at the first level."""
        return (1 - self.percent / 100) ** self.trees


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint of the set), mh (minwise hashes), SKETCH; the sketch is null for empty sets."""
    inner = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary").alias("t"))
    id_type = inner.schema["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import mix

        hashes = MinHash(SIGNATURE)
        for batch in batches:
            for part in sliced(batch, "t", 4 << 20):
                sets = list(shingle_sets(part.column("t").to_pylist(), width))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                some = [sets[i] for i in full]
                f = np.zeros((2, len(sets)), np.uint64)
                mh = np.zeros((len(sets), SIGNATURE), np.uint32)
                if some:
                    flat = np.concatenate(some)
                    offsets = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for j in range(2):
                        f[j, full] = np.add.reduceat(mix(flat, 77 + j), offsets)
                    mh[full] = hashes.of(some)
                # the sketch takes scrambled bits: the low bits of a minimum are not uniform for large sets
                nibbles = ((mh * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(len(sets), -1, 16)
                sketch = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)
                empty = n == 0
                first = np.ascontiguousarray(mh[:, :COORDINATES]).view(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), pa.array(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), *[pa.array(x.view(np.int64)) for x in f], lists, *[pa.array(np.ascontiguousarray(sketch[:, j]), mask=empty) for j in range(len(SKETCH))]],
                    names=["id", "n", "f1", "f2", "mh", *SKETCH])

    longs = [T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")]
    schema = T.StructType([id_type, *longs, T.StructField("mh", T.ArrayType(T.IntegerType())), *[T.StructField(k, T.LongType()) for k in SKETCH]])
    return inner.mapInArrow(sign, schema)


def agreement(a: str, b: str) -> Column:
    """Sketch positions in which rows aliased `a` and `b` agree."""
    differ = F.lit(0)
    for k in SKETCH:
        x = F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(NIBBLE)))
    return F.lit(SIGNATURE) - differ


def _similar(a: str, b: str, rules: NearDup) -> Column:
    """What every linked pair meets, but for the sketch's small chance: sizes and agreement."""
    least, most = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (least * 100 >= most * rules.percent) & (agreement(a, b) >= rules.least_agreement())


def _pick(node: Column, salt: int) -> Column:
    """The minwise hash that a node picks."""
    return F.get(F.col("mh"), F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(COORDINATES)).cast("int"))


def _children(rows: DataFrame, rules: NearDup, columns: list[str]) -> DataFrame:
    """rows (node, mh, columns) one level down: one picked coordinate, and a second one as often as needed.

    1 / similarity coordinates are expected: the second is picked with the rest's probability.
    """
    second = 100 / rules.percent - 1
    node = F.col("node")
    chance = F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1 << 20)) < int(second * (1 << 20))
    kids = F.array(F.xxhash64(node, F.lit(0), _pick(node, 0)), F.when(chance, F.xxhash64(node, F.lit(1), _pick(node, 1))))
    return rows.select(F.explode(kids).alias("node"), *columns).where("node is not null")


def _confirmed(pairs: DataFrame, texts: DataFrame, rules: NearDup) -> DataFrame:
    """The pairs (u, v) whose texts are linked by their full shingle sets.

    Only texts that some pair names move, once each: an id that many pairs name
    is a row here, and its joins are plain ones, which a skewed key may split.
    """
    ids = pairs.select(F.col("u").alias("s")).unionAll(pairs.select(F.col("v").alias("s"))).distinct()
    needed = materialize(texts.join(ids, "s"), "pair-texts")
    both = pairs.join(needed.select(F.col("s").alias("u"), F.col("t").alias("tu")), "u").join(needed.select(F.col("s").alias("v"), F.col("t").alias("tv")), "v")
    both = both.select("u", "v", "tu", "tv")
    width, percent = rules.width, rules.percent

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "tu", 2 << 20):
                n = part.num_rows
                found = list(shingle_sets([*part.column("tu").to_pylist(), *part.column("tv").to_pylist()], width))
                keep = []
                for i in range(n):
                    inter, union = jaccard_counts(found[i], found[n + i])
                    keep.append(union > 0 and 100 * inter >= percent * union)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    linked = materialize(both.mapInArrow(confirm, T.StructType([both.schema["u"], both.schema["v"]])).distinct(), "links")
    discard(needed)
    return linked


def _alike(pairs: DataFrame, sets: DataFrame, rules: NearDup) -> DataFrame:
    """The pairs (u, v) that agree in size and sketch as linked ones do, with their agreement g.

    Sketches are fetched for pairs only; nothing carries them through the trees.
    """
    named = lambda x: sets.select(F.col("s").alias(x), F.struct("n", *SKETCH).alias(f"of_{x}"))
    both = pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", F.col("of_u").alias("a"), F.col("of_v").alias("b"))
    return both.where(_similar("a", "b", rules)).select("u", "v", agreement("a", "b").alias("g"))


def _pivot_links(sets: DataFrame, rules: NearDup, turn: int) -> DataFrame:
    """Pairs (u, v): each member and the pivot most like it, of another component (column c), that it shares a node with.

    A pivot is an aggregate of its node, joined back to the members.
    """
    seeds = F.array(*[F.xxhash64(F.lit(rules.seed), F.lit(-turn), F.lit(t)) for t in range(rules.first_trees)])
    roots = sets.select("s", "c", "n", "mh", F.explode(seeds).alias("node"))
    one = roots.withColumn("node", F.xxhash64("node", F.lit(0), _pick(F.col("node"), 0)))
    two = one.withColumn("node", F.xxhash64("node", F.lit(0), _pick(F.col("node"), 0)))
    rows = two.select("node", "s", "c", "n")
    member = F.struct(F.xxhash64("node", "s").alias("h"), F.col("s").alias("v"), F.col("c").alias("pc"), F.col("n").alias("pn"))
    pivots = rows.groupBy("node").agg(F.min(member).alias("p"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("node", "p.v", "p.pc", "p.pn")
    pivots = materialize(pivots, "pivots")
    sizes = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * rules.percent
    near = materialize(rows.join(pivots, "node").where((F.col("c") != F.col("pc")) & sizes).select(F.col("s").alias("u"), "v").distinct(), "pivot-near")
    best = _alike(near, sets, rules).groupBy("u").agg(F.max(F.struct("g", "v")).alias("best"))
    found = materialize(best.select("u", F.col("best.v").alias("v")), "pivot-pairs")
    discard(pivots, near)
    return found


def _with_picks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (node, s, c, n) with the minwise hashes mh, which are fetched once a member, not once a node that it is in."""
    members = rows.groupBy("s", "c", "n").agg(F.collect_list("node").alias("nodes"))  # a few nodes a tree
    return members.join(sets.select("s", "mh"), "s").select("s", "c", "n", "mh", F.explode("nodes").alias("node"))


def _tree_pairs(sets: DataFrame, rules: NearDup) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (u, v) of different components (column c) that share a small node and pass the sketch; and
    the members (node, s, c, n) of the nodes that are large to the end."""
    light = ["s", "c", "n"]
    roots = sets.select(*light, "mh", F.explode(F.array(*[F.xxhash64(F.lit(rules.seed), F.lit(t)) for t in range(1, rules.trees + 1)])).alias("node"))
    rows = _children(roots, rules, light)
    found = None

    def compare(members: DataFrame) -> DataFrame:
        a, b = members.alias("a"), members.alias("b")
        sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * rules.percent
        pairs = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.s") > F.col("b.s")) & (F.col("a.c") != F.col("b.c")) & sizes)
        met = materialize(pairs.select(F.col("a.s").alias("u"), F.col("b.s").alias("v")).distinct(), "tree-met")
        return _alike(met, sets, rules).select("u", "v")

    for level in range(1, rules.max_levels + 1):
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        nodes = materialize(nodes.where("c0 != c1").select("node", "size"), "tree-nodes")  # a node of one component has nothing to add
        alive = materialize(rows.join(nodes, "node"), "tree-level")
        pairs = materialize(compare(alive.where(F.col("size") <= rules.leaf).select("node", *light)), "tree-pairs")
        found = pairs if found is None else found.unionAll(pairs)
        large = alive.where(F.col("size") > rules.leaf)
        if large.isEmpty():
            return found.distinct(), None
        if level < rules.max_levels:
            rows = materialize(_children(_with_picks(large.select("node", *light), sets), rules, light), "tree-rows")
    return found.distinct(), large.select("node", "s", "c", "n")


def _meetings(large: DataFrame, sets: DataFrame, texts: DataFrame, rules: NearDup) -> DataFrame:
    """The rows of each meeting of two blocks of a large node (or of one with itself), sides apart.

    In a node of several blocks, its largest component has blocks of its own,
    which do not meet each other: a group that is joined up already meets the
    rest only.
    """
    def many(rows: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(rows / rules.block_rows, shingles * 8 / rules.block_bytes)).cast("int")

    each = large.groupBy("node", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    nodes = each.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max(F.struct("rows", "shingles", "c")).alias("most"))
    one, most = many(F.col("rows"), F.col("shingles")) == 1, F.col("most")
    nodes = nodes.select("node", F.when(~one, most["c"]).alias("main"), F.when(one, 0).otherwise(many(most["rows"], most["shingles"])).alias("first"),
                         F.when(one, 1).otherwise(many(F.col("rows") - most["rows"], F.col("shingles") - most["shingles"])).alias("rest"))
    mine, salt = F.col("c").eqNullSafe(F.col("main")), F.xxhash64("s", "node")
    dealt = large.join(nodes, "node").select(
        "s", F.struct("node", F.when(mine, F.pmod(salt, F.col("first"))).otherwise(F.col("first") + F.pmod(salt, F.col("rest"))).cast("int").alias("own"),
                      F.when(mine, F.col("first")).otherwise(0).alias("from"), (F.col("first") + F.col("rest") - 1).alias("to")).alias("at"))
    # all that a member brings is put together once, before it goes to its meetings
    members = dealt.groupBy("s").agg(F.collect_set("at").alias("at")).join(sets.select("s", "c", "n", F.array(*SKETCH).alias("k")), "s").join(texts, "s")
    met = members.withColumn("nodes", F.array_sort("at.node")).withColumn("at", F.explode("at")).withColumn("other", F.explode(F.sequence("at.from", "at.to")))
    own, other = F.col("at.own"), F.col("other")
    return met.select(
        F.xxhash64("at.node", F.least(own, other), F.greatest(own, other)).alias("meeting"),
        F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), "at.node", "s", "nodes", "c", "n", "k", "t")


def _dense_links(large: DataFrame, sets: DataFrame, texts: DataFrame, rules: NearDup) -> DataFrame:
    """Linked pairs (u, v) of different components that share a large node: all of them are compared.

    A node's members are dealt to blocks, so many that a block's sets take
    block_bytes and its rows block_rows at most on average, and every two blocks
    meet in one task, which compares sketches and confirms on full sets; no row
    is made for a pair.  A pair that shares several nodes is examined in the
    smallest of them only.
    """
    width, percent, least = rules.width, rules.percent, rules.least_agreement()

    def meet(rows: pa.Table) -> pa.RecordBatch:
        side, s, c, n = (rows.column(x).to_numpy() for x in ("side", "s", "c", "n"))
        node = rows.column("node")[0].as_py()
        k = rows.column("k").combine_chunks().flatten().to_numpy().reshape(len(s), -1).view(np.uint8)
        nibbles = np.concatenate((k & 15, k >> 4), 1)
        nodes = [set(x) for x in rows.column("nodes").to_pylist()]
        sets_of = list(shingle_sets(rows.column("t").to_pylist(), width))
        parent = {int(x): int(x) for x in c}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        u, v = [], []
        across = side[0] != 2
        begin = int(np.searchsorted(side, 1)) if across else 0
        for i in range(begin if across else len(s)):
            j = np.arange(begin if across else i + 1, len(s))
            j = j[(c[j] != c[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
            j = j[(nibbles[j] == nibbles[i]).sum(1) >= least]
            for x in j.tolist():
                a, b = top(int(c[i])), top(int(c[x]))
                if a == b or min(nodes[i] & nodes[x]) != node:
                    continue
                inter, union = jaccard_counts(sets_of[i], sets_of[x])
                if union and 100 * inter >= percent * union:
                    parent[a] = b
                    u.append(int(s[i]))
                    v.append(int(s[x]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "meeting"):
            yield meet(group)

    return _meetings(large, sets, texts, rules).repartition("meeting").sortWithinPartitions("meeting", "side").mapInArrow(solve, "u long, v long")


def near_duplicates(docs: DataFrame, rules: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text", dealt: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_shingles (set size), component_id (smallest id reachable over links), kept.

    Ids must be integers.  Rows that share an id are one document with several
    texts.  A text without words, or null, has an empty set and is linked with
    nothing: its component is its own id.  A row of a null id takes no part: its
    component is null and it is kept.  An empty table gives an empty result.
    Extra columns are not read.  `dealt`: docs is bucketed by the id already.
    """
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("s"), docs[f"`{text_col}`"].cast("binary").alias("t"))
    if not dealt:  # once for all joins that fetch texts
        texts = bucketed(texts.where("s is not null and t is not null"), "texts", "s")
    signed = materialize(signatures(docs, rules.width, id_col, text_col), "signed")
    known = signed.where("n > 0 and id is not null")
    sets = materialize(
        known.groupBy("f1", "f2", "n").agg(F.min(F.col("id").cast("long")).alias("s"), F.first("mh").alias("mh"), *[F.first(k).alias(k) for k in SKETCH]),
        "sets")

    named, links = sets.withColumn("c", F.col("s")), None
    for turn in range(1, rules.first_rounds + 1):
        asked = _pivot_links(named, rules, turn)
        found = _confirmed(asked, texts, rules)
        links = found if links is None else links.unionByName(found)
        comps, older = components(links), named
        named = materialize(sets.join(comps, sets["s"] == comps["node"], "left").select(
            "s", F.coalesce("component", "s").alias("c"), "n", "mh", *SKETCH), "sets-named")
        discard(asked, *([older] if turn > 1 else []))
    pairs, large = _tree_pairs(named, rules)
    pairs = materialize(pairs, "pairs")
    more = _confirmed(pairs, texts, rules)
    if large is not None:
        more = more.unionByName(materialize(_dense_links(large, named, texts, rules), "dense-links"))
    # rows that share an id hold their sets together
    repeated = known.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    same = known.select("id", "f1", "f2", "n").join(repeated, "id", "left_semi").join(sets.select("f1", "f2", "n", "s"), ["f1", "f2", "n"])
    same = same.select(F.col("id").cast("long").alias("u"), F.col("s").alias("v")).where("u != v")
    final = components(links.unionByName(more).unionByName(same))

    discard(named, pairs)

    by_set = sets.join(final, sets["s"] == final["node"], "left").select("f1", "f2", "n", F.coalesce("component", "s").alias("component"))
    full = signed.where("n > 0").join(by_set, ["f1", "f2", "n"], "left").select("id", "n", "component")
    empty = signed.where("n = 0").select("id", "n", F.col("id").cast("long").alias("component"))
    out = full.unionAll(empty)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def keep_one(docs: DataFrame, rules: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` of each group of near copies: that of the smallest id, a null id last.

    Every row is a document of its own here, so repeated rows and rows of a null
    id are near copies like others, and rows that share an id but not the text
    are not.  Of rows without words, one of each id and text is kept.
    """
    rows = bucketed(docs.withColumn("__row", F.monotonically_increasing_id()), "keep", "__row")
    found = near_duplicates(rows, rules, "__row", text_col, dealt=True).select(F.col("__row").alias("__r"), F.col("n_shingles").alias("__n"), F.col("component_id").alias("__c"))
    # what groups rows without words: their id and text; null ids are alike in a groupBy
    wordless = F.col("__n") == 0
    keyed = rows.select("__row", rows[f"`{id_col}`"].alias("__id"), F.xxhash64(rows[f"`{text_col}`"]).alias("__h"), rows[f"`{text_col}`"].isNull().alias("__null")).join(found, F.col("__row") == F.col("__r"))
    group = [F.when(~wordless, F.col("__c")), F.when(wordless, F.col("__id")), F.when(wordless, F.col("__h")), F.when(wordless, F.col("__null"))]
    first = keyed.groupBy(*[g.alias(f"__g{k}") for k, g in enumerate(group)]).agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__first"))
    return rows.join(first.select(F.col("__first")["__row"].alias("__kept")), F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
