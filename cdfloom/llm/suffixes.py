"""Exact removal of long repeated substrings by blockwise suffix sorting with a cover sample.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else.  The suffixes that matter are those with `length` bytes left; only their
first `length` bytes matter.

Cover sample and buckets.  Every such suffix is put into the bucket of its
leftmost smallest k-gram among its first `length` bytes (a minimizer).  That
choice depends on these bytes alone, so equal strings meet in one bucket, at
equal distance from the sampled position; this local consistency is what a
difference cover's residues give for two suffixes of one text, and it keeps the
sample to two positions a window (0.7 % of all).  The suffixes between two
samples are one family: a run of starts over one stretch of text.

Ties.  Families are ranked by the fingerprint of their whole stretch: if
another has the same, all their suffixes tie to the full length, which the
sample's rank settles without sorting anything.  A bucket with families of one
stretch only is done.  Families that tie inside one text are settled where they
are found, and leave that task as one row and the joined ranges of their starts.

Sorting.  Buckets with several different stretches are suffix-sorted one batch
of buckets at a time, in numpy: ranks of all 31-byte prefixes, ranks of the
suffixes at the positions of a difference cover modulo 31 by doubling, and ties
of prefixes resolved by the cover ranks at a shift at which both suffixes hit
the cover.  Memory is bounded by the batch.  Buckets too large for a batch are
split first: a string has at least half of what is outside the sampled k-gram on
one side of it, and meets its equals by that half and the k-gram.  What is still
too large then counts its strings by fingerprint, a row a string, summed up
before any shuffle.

Passages.  On request, runs of a number of words that also start elsewhere go as
well, whatever their bytes: the same sample and buckets over words instead of
bytes, in the same tables.  The lowest bit of a bucket tells its unit.  Strings
of words are counted by fingerprint inside their bucket.  Every repeated start
carries its unit along, so one run can tell what bytes alone cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import sliced
from .common import SPACE_CHARS, bucketed, discard, materialize
from .shingles import U, mix

LENGTH = 400
GRAM = 128
WORD_GRAM = 8  # words whose fingerprint is sampled for passages
CHUNK_BYTES = 1 << 19
BATCH_BYTES = 1 << 20  # of stretches that are suffix-sorted at once
LARGE_BUCKET = 2048  # stretches
SPLITS = 2  # of large buckets of bytes, before their strings are counted
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 occurs
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

_random = np.random.default_rng(5)
_BYTES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_IS_SPACE = np.isin(np.arange(256), list(SPACE_CHARS.encode()))
_BASES = [int(x) * 4 + 1 for x in _random.integers(0, 1 << 62, 2)]


class _Prefix:
    """Polynomial prefix sums modulo 2**64 of a byte string, or of the hashes of words, for the fingerprint of any substring."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, a: np.ndarray, which: int) -> None:
        n = len(a) + 1
        if which not in self._powers or len(self._powers[which][0]) < n:
            made = []
            for x in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            self._powers[which] = (made[0], made[1])
        up, self.down = self._powers[which]
        self.total = np.zeros(n, np.uint64)
        np.cumsum((_BYTES[which][a] if a.dtype == np.uint8 else a) * up[:n - 1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For every i, the leftmost position of the smallest h in [i, i + width); h has fewer than 2**24 entries."""
    n = len(h)
    rows = -(-n // width)
    key = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:n] = (h & ~U(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    key = key.reshape(rows, width)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n - width + 1], left[width - 1:n]) & U(0xFFFFFF)).astype(np.int64)


def settled_inside(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, e1: np.ndarray, e2: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Families that occur again in their own text are settled: their starts repeat.

    Returns the numbers of one family of each kind and text, how often it occurs
    there, and (text, first, last start) of the settled ones, ranges that touch
    or overlap, with what they cover, joined.  So a text of one repeated
    character or phrase has a few rows, not one a byte.
    """
    order = np.lexsort((lo, e2, e1, text))
    t, a, b = text[order], e1[order], e2[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    again = np.sort(order[np.repeat(times, times) > 1])  # in text order again
    t, a, b = text[again], lo[again], hi[again]
    if not len(again):
        return order[first], times, (t, a, b)
    # families of one text come by rising starts, and so do their ends
    cut = np.ones(len(again), bool)
    cut[1:] = (t[1:] != t[:-1]) | (a[1:] > b[:-1] + length)
    begin = np.flatnonzero(cut)
    return order[first], times, (t[begin], a[begin], b[np.append(begin[1:], len(again)) - 1])


def families(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Families of the texts' suffixes: text number, first and last start, sampled position, bucket, fingerprint (two).

    Positions are byte offsets in the text.
    """
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < CHUNK_BYTES or upto == at):
            size += len(texts[upto])
            upto += 1
        out += _families(texts[at:upto], at, length, gram)
        at = upto
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (none, none, none, none, none, none, none)


def _families(texts: list[bytes], number: int, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    if len(texts) == 1 and len(texts[0]) > 1 << 23:  # a giant text, in overlapping stretches of whole suffixes
        text, step, out = texts[0], 1 << 22, []
        for base in range(0, len(text) - length + 1, step):
            for f in _families([text[base:base + step + length - 1]], number, length, gram):
                out.append((f[0], f[1] + base, f[2] + base, f[3] + base, *f[4:]))
        return out
    sizes = np.array([len(t) for t in texts])
    a = np.frombuffer(b"".join(texts), np.uint8)
    if len(a) < length:
        return []
    ends = np.cumsum(sizes)
    one = _Prefix(a, 0)
    starts = np.arange(len(a) - gram + 1)
    grams = mix(one.of(starts, starts + gram))
    anchor = sliding_argmin(grams, length - gram + 1)
    i = np.arange(len(anchor))
    text = np.searchsorted(ends, i, "right")
    valid = i + length <= ends[text]
    i, anchor, text = i[valid], anchor[valid], text[valid]
    if not len(i):
        return []
    new = np.ones(len(i), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    lo, x, text = i[first], anchor[first], text[first]
    hi = i[np.append(first[1:], len(i)) - 1]
    shape = mix(((x - lo) << 20 | (hi - lo)).astype(np.uint64), 3)
    e1 = mix(one.of(lo, hi + length) ^ shape, 1)
    e2 = mix(_Prefix(a, 1).of(lo, hi + length) + shape, 2)
    base = ends[text] - sizes[text]
    signed = lambda u: u.view(np.int64)
    return [(text + number, lo - base, hi - base, x - base, signed(grams[x]), signed(e1), signed(e2))]


@dataclass
class _Words:
    """Words of texts, in order: text number, byte offset of the word and of what follows it (the next word or the text's end), hashes."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes]) -> _Words:
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        a = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        edge = np.flatnonzero(np.diff((~_IS_SPACE[a]).astype(np.int8), prepend=0))
        begin, stop = edge[::2], edge[1::2]
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, begin, "right")
        follows = np.append(begin[1:], len(a))
        follows = np.minimum(follows, ends[text] - 1)
        base = ends[text] - sizes[text]
        return cls(text, begin - base, follows - base, tuple(mix(_Prefix(a, w).of(begin, stop), w + 6) for w in (0, 1)))

    def windows(self, words: int) -> np.ndarray:
        """First words of all runs of `words` words inside a text."""
        i = np.arange(max(0, len(self.text) - words + 1))
        return i[self.text[i] == self.text[i + words - 1]]


def passage_families(texts: list[bytes], words: int, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """Families of the texts' runs of `words` words: text number, first and last byte + 1 of the stretch, bucket, fingerprint (two)."""
    out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(6))]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < CHUNK_BYTES or upto == at):
            size += len(texts[upto])
            upto += 1
        found = _Words.of(texts[at:upto])
        step = 1 << 22
        for base in range(0, len(found.text) - words + 1, step):  # overlapping stretches of whole runs
            cut = slice(base, base + step + words - 1)
            part = _Words(found.text[cut], found.start[cut], found.end[cut], tuple(h[cut] for h in found.hashes))
            out.append(_passage_families(part, at, words, gram))
        at = upto
    return tuple(np.concatenate(c) for c in zip(*out))


def _passage_families(found: _Words, number: int, words: int, gram: int) -> tuple[np.ndarray, ...]:
    one, two = (_Prefix(h, w) for w, h in enumerate(found.hashes))
    starts = np.arange(len(found.text) - gram + 1)
    grams = mix(one.of(starts, starts + gram), 5)
    i = found.windows(words)
    anchor = sliding_argmin(grams, words - gram + 1)[i]
    text = found.text[i]
    new = np.ones(len(i), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    lo, x = i[first], anchor[first]
    hi = i[np.append(first[1:], len(i)) - 1] if len(i) else i
    shape = mix(((x - lo) << 20 | (hi - lo)).astype(np.uint64), 4)
    e1 = mix(one.of(lo, hi + words) ^ shape, 1)
    e2 = mix(two.of(lo, hi + words) + shape, 2)
    return (found.text[lo] + number, found.start[lo], found.end[hi + words - 1], *(u.view(np.int64) for u in (grams[x], e1, e2)))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def repeated_suffixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For suffixes `starts` of `text`, whether the first `length` bytes of another of them are the same.

    A suffix array of the batch to depth `length`, up to what the question
    needs: prefix ranks of PERIOD bytes, and long ties by cover ranks.
    """
    reach = (length - 2 * PERIOD) // PERIOD * PERIOD + PERIOD  # depth of the cover ranks
    if not (length - 2 * PERIOD <= reach <= length - PERIOD + 1):
        raise ValueError(f"length {length} has no cover depth")
    n = len(text)
    padded = np.zeros(n + 2 * PERIOD + 8, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    r8 = _dense(np.ascontiguousarray(words[:n + PERIOD + 8]).view(">u8").ravel().astype(np.uint64))
    r16 = _dense(r8[:n + PERIOD] << U(32) | r8[8:n + PERIOD + 8])
    prefix = _dense(r16[:n] << U(32) | r16[PERIOD - 16:n + PERIOD - 16])

    cover = (np.arange(0, -(-n // PERIOD)) * PERIOD)[:, None] + np.array(COVER)
    cover = cover.ravel()
    step, depth = len(COVER), PERIOD
    rank = prefix[np.minimum(cover, n - 1)]
    while depth < reach:
        more = min(depth, reach - depth)  # a second half that may overlap the first
        shift = more // PERIOD * step
        other = np.zeros_like(rank)
        other[:len(rank) - shift] = rank[shift:]
        rank = _dense(rank << U(32) | other)
        depth += more

    head, near, tail = prefix[starts], prefix[starts + length - 2 * PERIOD], prefix[starts + length - PERIOD]
    same = _dense(_dense(head << U(32) | tail) << U(32) | near)
    counts = np.bincount(same.astype(np.int64))
    tied = np.flatnonzero(counts[same.astype(np.int64)] > 1)
    out = np.zeros(len(starts), bool)
    if not len(tied):
        return out
    p, group = starts[tied], _dense(same[tied])
    slot = {d: k for k, d in enumerate(COVER)}
    slots = np.array([slot.get(r, 0) for r in range(PERIOD)])
    keys = []
    for d in COVER:
        shift = (d - p) % PERIOD
        q = p + shift
        keys.append((group * U(PERIOD) + shift.astype(np.uint64)) << U(28) | rank[q // PERIOD * step + slots[q % PERIOD]])
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    out[tied] = (count[inverse] > 1).reshape(len(COVER), -1).any(0)
    return out


@dataclass
class Repeats:
    """docs: id, k1, k2 (fingerprint of the text).  texts: k1, k2, n_bytes, n_removed, spans, kept (bytes); if asked, the last three by strings of bytes alone as well, named bytes_*."""

    docs: DataFrame
    texts: DataFrame


def _key(text):
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """k1, k2, copies, t: bucketed by the key in a table of the shared folder, so that later joins don't move texts."""
    return bucketed(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("t").alias("t")), "texts", "k1", "k2")


_FAMILY = [*[T.StructField(c, T.LongType()) for c in ("times", "lo", "hi", "bucket", "e1", "e2")], T.StructField("passage", T.BooleanType())]


def _find_families(texts: DataFrame, length: int, words: int) -> DataFrame:
    """k1, k2, copies, times (in the text), lo, hi, bucket, e1, e2, passage (of words); a settled range of starts has a null bucket."""
    inner = texts.select("k1", "k2", "copies", "t")

    def rows(part: pa.RecordBatch, text: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        taken = part.select(["k1", "k2", "copies"]).take(pa.array(text))
        return pa.RecordBatch.from_arrays([*taken.columns, *columns], names=["k1", "k2", "copies", *[f.name for f in _FAMILY]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t", 4 << 20):
                strings = part.column("t").to_pylist()
                text, lo, hi, _, bucket, e1, e2 = families(strings, length)
                found = [(text, lo, hi, bucket & ~1 if words else bucket, e1, e2)]
                if words:  # a family of words ends `length` bytes behind its `hi`, as one of bytes does
                    text, begin, end, bucket, e1, e2 = passage_families(strings, words)
                    found.append((text, begin, end - length, bucket | 1, e1, e2))
                for passage, (text, lo, hi, bucket, e1, e2) in enumerate(found):
                    one, times, settled = settled_inside(text, lo, hi, e1, e2, length)
                    unit = pa.array(np.full(len(one), passage, bool))
                    yield rows(part, text[one], pa.array(times.astype(np.int64)), *[pa.array(c[one]) for c in (lo, hi, bucket, e1, e2)], unit)
                    if len(settled[0]):
                        none = pa.nulls(len(settled[0]), pa.int64())
                        unit = pa.array(np.full(len(settled[0]), passage, bool))
                        yield rows(part, settled[0], none, pa.array(settled[1]), pa.array(settled[2]), none, none, none, unit)

    return inner.mapInArrow(find, T.StructType([*[T.StructField(c, T.LongType()) for c in ("k1", "k2", "copies")], *_FAMILY]))


def _met_again(found: DataFrame) -> DataFrame:
    """The families whose bucket holds more than one occurrence; a string of the others starts nowhere else.

    Only buckets are counted over all families; what is sorted and compared later has the few that are left.
    """
    buckets = found.groupBy("bucket").agg(F.sum(F.col("copies") * F.col("times")).alias("n")).where("n > 1").select("bucket")
    return found.join(buckets, "bucket", "left_semi").select(found.columns)


_STARTS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("k1", "k2", "from", "to")], T.StructField("passage", T.BooleanType())])


def _starts(keys: pa.RecordBatch, first: np.ndarray, last: np.ndarray, passage: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(first), pa.array(last), pa.array(np.full(len(first), passage))], names=_STARTS.names)


def _of_words(words: int) -> Column:
    """Whether a bucket is one of words; without them, its lowest bit is its hash's."""
    return F.col("bucket").bitwiseAND(1) == 1 if words else F.lit(False)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] - 1


def _passage_runs(rows: pa.RecordBatch, length: int, words: int) -> pa.RecordBatch:
    """k1, k2, from, to, passage: runs of words in open stretches of whole buckets that also start elsewhere there."""
    found = _Words.of(rows.column("stretch").to_pylist())
    i = found.windows(words)
    one, two = (_dense(_Prefix(h, w).of(i, i + words)) for w, h in enumerate(found.hashes))
    _, inverse, count = np.unique(one << U(32) | two, return_inverse=True, return_counts=True)
    i = i[count[inverse] > 1]
    i = i[rows.column("open").to_numpy(zero_copy_only=False)[found.text[i]]]
    row = found.text[i]
    lo = rows.column("lo").to_numpy()[row]
    keys = rows.select(["k1", "k2"]).take(pa.array(row))
    return _starts(keys, lo + found.start[i], lo + found.end[i + words - 1] - length, True)


def _sorted_buckets(stretches: DataFrame, length: int, words: int) -> DataFrame:
    """k1, k2, from, to, passage: runs of repeated starts in the open stretches, bucket by bucket.

    Rows come sorted by bucket; whole buckets are gathered up to a batch.
    """
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        (rows,) = rows.combine_chunks().to_batches()
        if words:
            of_words = (rows.column("bucket").to_numpy() & 1).astype(bool)
            if of_words.any():
                yield _passage_runs(rows.filter(pa.array(of_words)), length, words)
            rows = rows.filter(pa.array(~of_words))
        if rows.num_rows:
            yield solve_bytes(rows)

    def solve_bytes(rows: pa.RecordBatch) -> pa.RecordBatch:
        parts = rows.column("stretch").to_pylist()
        sizes = np.array([len(s) for s in parts])
        offset = np.cumsum(sizes) - sizes
        many = sizes - length + 1
        of = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        again = repeated_suffixes(np.frombuffer(b"".join(parts), np.uint8), offset[of] + nth, length)
        # a gap behind each stretch keeps its runs apart from the next one's
        base = np.cumsum(many + 1) - (many + 1)
        flags = np.zeros(int((many + 1).sum()), bool)
        flags[base[of] + nth] = again
        a, b = _runs(flags)
        row = np.searchsorted(base, a, "right") - 1
        unsure = rows.column("open").to_numpy(zero_copy_only=False)[row]
        row, a, b = row[unsure], a[unsure], b[unsure]
        first = rows.column("lo").to_numpy()[row] - base[row]
        keys = rows.select(["k1", "k2"]).take(pa.array(row))
        return _starts(keys, first + a, first + b, False)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in sliced(batch, "stretch", BATCH_BYTES):
                if held and size >= BATCH_BYTES:
                    # cut behind the last whole bucket of what is held
                    table = pa.Table.from_batches(held)
                    bucket = table.column("bucket").to_numpy()
                    cut = len(bucket) if part.column("bucket")[0].as_py() != bucket[-1] else int(np.searchsorted(bucket, bucket[-1], "left"))
                    if cut:
                        yield from solve(table.slice(0, cut))
                        rest = table.slice(cut)
                        held = rest.to_batches() if len(rest) else []
                        size = sum(b.nbytes for b in held)
                held.append(part)
                size += part.nbytes
        if held:
            yield from solve(pa.Table.from_batches(held))

    columns = stretches.select("bucket", "k1", "k2", "lo", "open", "stretch")
    return columns.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, _STARTS)


def _split(stretches: DataFrame, length: int, words: int) -> DataFrame:
    """Stretches of large buckets of bytes, in up to two parts each, in buckets of their own; those that meet nothing there are left out.

    All strings of a bucket have its `core` bytes in common, which lie `at` in
    the stretch (null: the sampled gram).  A string that starts at least half of
    the other bytes ahead of them has these as core of its part, any other string
    the rest behind; both depend on the string alone, so equal ones stay together.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "stretch", 1 << 18):
                row, out = [], []
                for r, (bucket, lo, s, at, core) in enumerate(zip(*(part.column(c).to_pylist() for c in ("bucket", "lo", "stretch", "at", "core")))):
                    a = np.frombuffer(s, np.uint8)
                    last = len(a) - length
                    one = _Prefix(a, 0)
                    if at is None:  # the leftmost such gram that all strings hold
                        i = np.arange(last, len(a) - GRAM + 1)
                        grams = mix(one.of(i, i + GRAM)).view(np.int64)
                        at, core = last + int(np.argmax((grams & ~1 if words else grams) == bucket)), GRAM
                    ahead = (length - core + 1) // 2
                    for side, (first, final, x, y) in enumerate(((0, min(last, at - ahead), at - ahead, at + core), (max(0, at - ahead + 1), last, at, at + length - ahead + 1))):
                        if first <= final:
                            key = mix(one.of(np.array([x]), np.array([y])) ^ mix(np.array([bucket]).view(np.uint64), side), 8).view(np.int64)
                            row.append(r)
                            out.append((int(key[0]) & ~1 if words else int(key[0]), lo + first, s[first:final + length], x - first, y - x))
                if row:
                    taken = part.select(["k1", "k2", "open"]).take(pa.array(row))
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=["k1", "k2", "open", "bucket", "lo", "stretch", "at", "core"])

    schema = "k1 long, k2 long, open boolean, bucket long, lo long, stretch binary, at long, core long"
    made = materialize(stretches.select("k1", "k2", "open", "bucket", "lo", "stretch", "at", "core").mapInArrow(parts, schema), "stretches-split")
    met = made.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max("open").alias("any")).where("kinds > 1 and any").select("bucket", "kinds")
    return materialize(made.join(met, "bucket"), "stretches-met")


def _counted_strings(stretches: DataFrame, length: int, words: int) -> DataFrame:
    """k1, k2, from, to, passage of repeated starts in the open stretches of large buckets, by counting fingerprints of strings."""
    def of_bytes(parts: list[bytes]) -> tuple[np.ndarray, ...]:
        row, at, h = [], [], []
        for r, s in enumerate(parts):
            a = np.frombuffer(s, np.uint8)
            i = np.arange(len(a) - length + 1)
            h.append(np.stack([mix(_Prefix(a, w).of(i, i + length), w) for w in (0, 1)]))
            row.append(np.full(len(i), r))
            at.append(i)
        at = np.concatenate(at)
        return np.concatenate(row), at, at, np.concatenate(h, 1).view(np.int64)

    def of_words(parts: list[bytes]) -> tuple[np.ndarray, ...]:
        found = _Words.of(parts)
        i = found.windows(words)
        h = np.stack([mix(_Prefix(x, w).of(i, i + words), w) for w, x in enumerate(found.hashes)]).view(np.int64)
        return found.text[i], found.start[i], found.end[i + words - 1] - length, h

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "stretch", 1 << 18):
                unit = (part.column("bucket").to_numpy() & 1).astype(bool) if words else np.zeros(part.num_rows, bool)
                for passage, (chosen, made) in enumerate(((~unit, of_bytes), (unit, of_words))):
                    if chosen.any():
                        some = part.filter(pa.array(chosen))
                        row, at, to, h = made(some.column("stretch").to_pylist())
                        taken = some.select(["k1", "k2", "open"]).take(pa.array(row))
                        lo = some.column("lo").to_numpy()[row]
                        kind = pa.array(np.full(len(row), passage, bool))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lo + at), pa.array(lo + to), kind, pa.array(h[0]), pa.array(h[1])], names=schema.names)

    schema = T.StructType([*_STARTS.fields[:2], T.StructField("open", T.BooleanType()), *_STARTS.fields[2:], *[T.StructField(c, T.LongType()) for c in ("h1", "h2")]])
    rows = stretches.select("bucket", "k1", "k2", "lo", "open", "stretch").mapInArrow(strings, schema)
    counts = rows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    return rows.where("open").join(counts, ["h1", "h2"], "left_semi").select(*_STARTS.names)


def find_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, words: int = 0, bytes_apart: bool = False) -> Repeats:
    """Which bytes of every text are covered by a string of `length` bytes that also starts elsewhere, and the rest.

    Null texts count as empty.  Texts shorter than `length` lose nothing; every
    copy of a repeated text loses all that the text's copies share.  Strings
    never cross texts and are judged on the input.  `whole_characters` leaves
    the rests of characters that a cut splits out of `kept`, so that it is a
    text again.  With `words`, runs of so many words (at least WORD_GRAM) that
    also start elsewhere are covered too, with the white space behind them; words
    are compared, not the white space between; `bytes_apart` then adds
    bytes_removed, bytes_spans and bytes_kept, what strings of bytes alone cover
    and leave.  An empty table gives an empty result; extra columns are not read.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary")
    keyed = docs.select(docs[f"`{id_col}`"].alias("id"), text.alias("t")).select("id", *_key(F.col("t")), "t")
    texts = _distinct_texts(keyed.select("k1", "k2", "t"))
    shortest = min(length, 2 * words - 1) if words else length
    all_found = materialize(_find_families(texts.where(F.octet_length("t") >= shortest), length, words), "families")

    settled = materialize(all_found.where("bucket is null").select("k1", "k2", F.col("lo").alias("from"), F.col("hi").alias("to"), "passage"), "settled")
    found = materialize(_met_again(all_found.where("bucket is not null").drop("passage")), "families-met")
    discard(all_found)
    kinds = materialize(found.groupBy("bucket", "e1", "e2").agg(
        F.sum(F.col("copies") * F.col("times")).alias("times"), *[F.first(c).alias(c) for c in ("k1", "k2", "lo", "hi")]), "kinds")
    several = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("bucket", "kinds")
    unsettled = kinds.join(several, "bucket")
    wanted = unsettled.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "kinds", "lo", "hi", (F.col("times") == 1).alias("open"))).alias("f"))
    cut = texts.select("k1", "k2", "t").join(wanted, ["k1", "k2"]).select("k1", "k2", F.explode(F.transform("f", lambda f: F.struct(
        f["bucket"].alias("bucket"), f["kinds"].alias("kinds"), f["lo"].alias("lo"), f["open"].alias("open"),
        F.substring("t", (f["lo"] + 1).cast("int"), (f["hi"] - f["lo"] + length).cast("int")).alias("stretch")))).alias("s"))
    stretches = materialize(cut.select("k1", "k2", "s.*"), "stretches")
    columns = ["bucket", "k1", "k2", "lo", "open", "stretch"]
    is_large = F.col("kinds") > LARGE_BUCKET
    small, large = stretches.where(~is_large).select(columns), stretches.where(is_large)
    of_bytes = large.where(~_of_words(words)).withColumns({c: F.lit(None).cast("long") for c in ("at", "core")})
    large = large.where(_of_words(words)).select(columns)
    for _ in range(SPLITS if length >= 2 * GRAM else 0):
        if of_bytes.isEmpty():
            break
        split = _split(of_bytes, length, words)
        small = small.unionAll(split.where(~is_large).select(columns))
        of_bytes = split.where(is_large)
    large = large.unionAll(of_bytes.select(columns))
    ranges = _sorted_buckets(small, length, words)
    if not large.isEmpty():
        ranges = ranges.unionAll(_counted_strings(large, length, words))

    again = kinds.where("times > 1").select("e1", "e2")
    whole = found.select("e1", "e2", "k1", "k2", "lo", "hi", _of_words(words).alias("passage")).join(again, ["e1", "e2"], "left_semi").select(
        "k1", "k2", F.col("lo").alias("from"), F.col("hi").alias("to"), "passage")
    starts = whole.unionAll(settled).unionAll(ranges).groupBy("k1", "k2").agg(F.collect_list(F.struct("from", "to", "passage")).alias("r"))

    joined = texts.select("k1", "k2", "t").join(starts, ["k1", "k2"], "left")
    return Repeats(keyed.select("id", "k1", "k2"), _cut_texts(joined, length, whole_characters, bytes_apart))


def _covered(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what strings of `length` bytes cover, in order, from runs of their starts."""
    if not len(first):
        return first, last
    a, b = np.sort(first), np.sort(last) + length  # sorted apart, they bound the same union, nested runs or not
    new = np.append(True, a[1:] > np.maximum.accumulate(b)[:-1])
    return a[new], np.append(b[:-1][new[1:]], b[-1])


def _cut_texts(joined: DataFrame, length: int, whole_characters: bool, bytes_apart: bool) -> DataFrame:
    """k1, k2, t, r (runs of starts) -> k1, k2, n_bytes, n_removed, spans (from, to; in order), kept; the last three without passages as well, if asked."""
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    names = [("n_removed", "spans", "kept"), ("bytes_removed", "bytes_spans", "bytes_kept")][:1 + bytes_apart]
    kinds = ("long", "array<struct<`from`: long, `to`: long>>", "binary")

    def without(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, list[dict[str, int]], bytes]:
        rest = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
        spans = [{"from": x, "to": y} for x, y in zip(begin.tolist(), end.tolist())]
        return int((end - begin).sum()), spans, rest.decode(errors="ignore").encode() if whole_characters and spans else rest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t", 4 << 20):
                sizes, rules = [], [([], [], []) for _ in range(1 + bytes_apart)]
                for text, runs in zip(part.column("t").to_pylist(), part.column("r")):
                    sizes.append(len(text))
                    if not runs.is_valid:
                        for rule in rules:
                            for column, x in zip(rule, (0, [], text)):
                                column.append(x)
                        continue
                    first, last, passage = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("from", "to", "passage"))
                    for rule, taken in zip(rules, (slice(None), ~passage)):
                        for column, x in zip(rule, without(text, *_covered(first[taken], last[taken], length))):
                            column.append(x)
                columns = [c for removed, spans, kept in rules for c in (pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(sizes, pa.int64()), *columns], names=["k1", "k2", "n_bytes", *[c for rule in names for c in rule]])

    return joined.select("k1", "k2", "t", "r").mapInArrow(cut, ", ".join(["k1 long, k2 long, n_bytes long", *[f"{c} {kind}" for rule in names for c, kind in zip(rule, kinds)]]))


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """`docs` with the repeated bytes (and runs of `words` words) cut out of every text; a character that a cut splits goes whole.

    Null texts stay null.  All rows and columns stay.
    """
    found = find_repeats(docs, length, id_col, text_col, whole_characters=True, words=words).texts.where("n_removed > 0").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.decode("kept", "UTF-8").alias("__kept"))
    text = F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary")
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(_key(text), ("__d1", "__d2"))])
    rest = F.when(F.col("__kept").isNotNull() & F.col(f"`{text_col}`").isNotNull(), F.col("__kept")).otherwise(F.col(f"`{text_col}`"))
    columns = [rest.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    joined = keyed.join(found, (keyed["__d1"] == found["__k1"]) & (keyed["__d2"] == found["__k2"]), "left")
    return joined.select(*columns)
