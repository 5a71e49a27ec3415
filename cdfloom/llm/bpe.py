"""Byte-level BPE: vectorised pre-tokenisation without regex, cached pair merging, decoding.

The split pattern is the usual one of byte-level vocabularies
('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+).
It is recognised by a small automaton over codepoint classes.  Every character
stands for a transition function of that automaton; the functions that can
arise form a finite monoid, so prefix composition is an associative scan over
one byte a character with a composition table: in parallel over blocks, then
over block totals.  Piece boundaries follow from neighbouring states.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import sliced

#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Character classes.  STMD ends a contraction at once; R, V and L2 need E, E and L2 after them.
LETTER, STMD, R, V, L2, E, NUMBER, OTHER, QUOTE, BLANK, SPACE, BREAK = range(12)
#: States, named after the last character read.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_QUOTE, S_R, S_V, S_L, S_DONE = range(11)
LETTERS = (LETTER, STMD, R, V, L2, E)
IDENTITY = 0
BLOCK = 256  # characters a block of the scan
CHUNK_BYTES = 1 << 20  # of text that is tokenised at once: bounds the worker's memory
CACHE_ENTRIES = 150_000  # in each of two generations
SHORT_PIECE = 40  # bytes


def _step(state: int, cls: int) -> int:
    if cls == BREAK:
        return S_START
    if state == S_QUOTE and cls in (STMD, R, V, L2):
        return {STMD: S_DONE, R: S_R, V: S_V, L2: S_L}[cls]
    if (state, cls) in ((S_R, E), (S_V, E), (S_L, L2)):
        return S_DONE
    if cls in LETTERS:
        return S_LETTER
    if cls == QUOTE:
        # a quote opens a piece unless a blank before it or a run of others takes it in
        return S_OTHER if state in (S_BLANK, S_OTHER, S_QUOTE) else S_QUOTE
    return {NUMBER: S_NUMBER, OTHER: S_OTHER, BLANK: S_BLANK, SPACE: S_SPACE}[cls]


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table (flat), id of each class's function, state after each function from the start."""
    generators = [tuple(_step(s, c) for s in range(11)) for c in range(12)]
    elements = [tuple(range(11))]
    index = {elements[0]: 0}
    for f in elements:  # grows while it is read
        for g in generators:
            h = tuple(g[f[s]] for s in range(11))
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    n = len(elements)
    assert n <= 256
    table = np.zeros((256, 256), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            h = tuple(g[f[s]] for s in range(11))
            if h not in index:
                raise AssertionError("the functions are not closed under composition")
            table[i, j] = index[h]
    return table.ravel(), np.array([index[g] for g in generators], np.uint8), np.array([f[S_START] for f in elements], np.uint8)


def _class_table() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    out[[ord(x) for x in "stmd"]] = STMD
    for x, k in (("r", R), ("v", V), ("l", L2), ("e", E), ("'", QUOTE), (" ", BLANK)):
        out[ord(x)] = k
    return out


class PreTokenizer:
    """Finds piece boundaries of many texts at once."""

    def __init__(self) -> None:
        self.classes = _class_table()
        self.compose, self.function_of_class, self.state_of = _monoid()

    def states(self, classes: np.ndarray) -> np.ndarray:
        """State after each character, by a blocked scan of transition functions."""
        n = len(classes)
        return self.state_of[self._scan(self.function_of_class[classes])[:n]]

    def _scan(self, f: np.ndarray) -> np.ndarray:
        n = len(f)
        rows = -(-n // BLOCK)
        padded = np.full(rows * BLOCK, IDENTITY, np.uint8)
        padded[:n] = f
        columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        for j in range(1, BLOCK):
            columns[j] = self.compose[(columns[j - 1].astype(np.uint16) << 8) | columns[j]]
        if rows > 1:
            before = self._scan(columns[-1]) if rows > 64 else self._serial(columns[-1])
            for j in range(BLOCK):
                columns[j, 1:] = self.compose[(before[:-1].astype(np.uint16) << 8) | columns[j, 1:]]
        return np.ascontiguousarray(columns.T).ravel()[:n]

    def _serial(self, f: np.ndarray) -> np.ndarray:
        out = f.copy()
        for i in range(1, len(out)):
            out[i] = self.compose[(int(out[i - 1]) << 8) | int(out[i])]
        return out

    def boundaries(self, codepoints: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """True where a piece starts.  `breaks`: positions of separators between texts, each a piece of its own."""
        cls = self.classes[codepoints]
        cls[breaks] = BREAK
        st = self.states(cls)
        prev = np.empty_like(st)
        prev[0], prev[1:] = S_START, st[:-1]
        nxt = np.full_like(cls, BREAK)
        nxt[:-1] = cls[1:]
        is_break = cls == BREAK
        space = (cls == BLANK) | (cls == SPACE)
        prev_space = (prev == S_BLANK) | (prev == S_SPACE)
        start = is_break | (prev == S_START)
        # white space: the run's first, and its last if a non-space follows
        start |= space & (~prev_space | ((nxt != BLANK) & (nxt != SPACE) & (nxt != BREAK)))
        letter = (cls <= E)
        # the state before a run of letters, looking through the unfinished contraction states
        in_letters = (prev == S_LETTER) | (prev == S_R) | (prev == S_V) | (prev == S_L)
        start |= letter & ~in_letters & (prev != S_BLANK)
        start |= (cls == NUMBER) & (prev != S_NUMBER) & (prev != S_BLANK)
        other = (cls == OTHER) | (cls == QUOTE)
        start |= other & (prev != S_OTHER) & (prev != S_QUOTE) & (prev != S_BLANK)
        # a finished contraction is one piece: nothing starts inside it
        done = np.flatnonzero(st == S_DONE)
        one = done[prev[done] == S_QUOTE]
        two = done[prev[done] != S_QUOTE]
        start[one] = False
        start[two] = False
        start[two - 1] = False
        return start


class BytePairEncoder:
    """Encodes and decodes with a rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pre = PreTokenizer()
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always merge the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT_PIECE:
            return self._merge_short(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or ranks.get(piece[i:end[j]]) != r:
                continue
            end[i], end[j] = end[j], 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := ranks.get(piece[i:end[after[j]]])) is not None:
                    heapq.heappush(heap, (s, i))
            if (p := before[i]) >= 0 and (s := ranks.get(piece[p:end[i]])) is not None:
                heapq.heappush(heap, (s, p))
        return [ranks[piece[i:end[i]]] for i in range(n) if end[i]]

    def _merge_short(self, piece: bytes) -> list[int]:
        """As merge(), by rescanning the ranks of all pairs: quicker than a heap for a word."""
        ranks, never = self.ranks, 1 << 60
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i:i + 2], never) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != never:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        return [ranks[p] for p in parts]

    def _missing(self, piece: bytes) -> bytes:
        """The ids of a piece that the young cache lacks; a full cache becomes the old one."""
        ids = self.old.get(piece)
        if ids is None:
            ids = struct.pack(f"<{len(m := self.merge(piece))}I", *m)
        if len(self.cache) >= CACHE_ENTRIES:
            self.old = dict(self.cache)
            self.cache.clear()  # callers hold its get()
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for group in _groups(texts):
            out += self._encode_group(group)
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # of the separators
        starts = np.flatnonzero(self.pre.boundaries(cp, ends))
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        data = joined.encode()
        bounds = byte_at[starts].tolist()
        bounds.append(len(data))
        get, missing = self.cache.get, self._missing
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        packed = [get(p) or missing(p) for p in pieces]
        first = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1))).tolist()  # piece where each text starts
        last = np.searchsorted(starts, ends).tolist()  # the separator's piece
        return [b"".join(packed[a:b]) for a, b in zip(first, last)]

    def token_ends(self, packed: bytes) -> np.ndarray:
        """Byte offset where each token ends in the text: kept for partial decoding and attribution."""
        return np.cumsum(self.length_of[np.frombuffer(packed, "<u4")])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a rank file, built once a worker process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


SLICE_BYTES = 2 << 20  # of a batch that is encoded or decoded at once


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The columns `keep` (default: all) and `ids_col`: the token ids of the whole text, packed
    as little-endian unsigned 32-bit integers.

    `vocabulary` is the path of a rank file that every executor can read.  A
    null text is encoded as the empty one, to no ids.  `verify` decodes the ids
    again in the same worker and raises an error if they are not the text.  An input column named
    like `ids_col` is replaced.  Very long texts are one unit each; a worker
    holds about a megabyte of text and one text more.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != ids_col.lower()]
    inner = docs.select(F.struct(F.lit(0).alias("_"), *[docs[f"`{c}`"] for c in kept]).alias("row"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in sliced(batch, "t", SLICE_BYTES):
                texts = part.column("t").to_pylist()
                ids = enc.encode(texts)
                if verify and any(enc.decode(i) != t.encode() for i, t in zip(ids, texts)):
                    raise ValueError("tokens do not decode to the text")
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.binary())], names=["row", "ids"])

    schema = T.StructType([inner.schema["row"], T.StructField("ids", T.BinaryType())])
    out = inner.mapInArrow(encode, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("ids").alias(ids_col))


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """`encoded` with `bytes_col`, the bytes that the ids stand for (null ids: no bytes), in place of `ids_col` or after it."""
    kept = [c for c in encoded.columns if c.lower() not in (ids_col.lower(), bytes_col.lower())]
    inner = encoded.select(F.struct(F.lit(0).alias("_"), *[encoded[f"`{c}`"] for c in kept]).alias("row"), F.coalesce(encoded[f"`{ids_col}`"], F.lit(b"")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in sliced(batch, "ids", SLICE_BYTES):
                data = pa.array([enc.decode(x.as_buffer()) for x in part.column("ids")], pa.binary())
                columns = [part.column("row"), *([part.column("ids")] if keep_ids else []), data]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *(["ids"] if keep_ids else []), "bytes"])

    binary = [T.StructField(c, T.BinaryType()) for c in ([*(["ids"] if keep_ids else []), "bytes"])]
    out = inner.mapInArrow(decode, T.StructType([inner.schema["row"], *binary]))
    ids = [F.col("ids").alias(ids_col)] if keep_ids else []
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *ids, F.col("bytes").alias(bytes_col))
