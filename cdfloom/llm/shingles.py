"""Word shingles as 64-bit hashes, for many texts at once with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  A
word's hash comes from prefix sums of a polynomial over random byte values, so
all words of a chunk are hashed without a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 19
U = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_WEIGHT = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_random.integers(0, 1 << 62)) * 4 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ U((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(n, x, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    data = b"\n".join(texts).translate(_LOWER) + b"\n"
    a = np.frombuffer(data, np.uint8)
    up, down = _powers.upto(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:-1], out=total[1:])
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than `width` words, but some, has its whole sequence of
    words as one shingle; one without words has none.
    """
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < CHUNK_BYTES or upto == at):
            size += len(texts[upto])
            upto += 1
        h, counts = word_hashes(texts[at:upto])
        n = len(h)
        rolled = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            rolled[:n - k] += h[k:] * _WEIGHT[k]
        rolled = mix(rolled, width)
        first = 0
        for c in counts.tolist():
            if c >= width:
                yield np.unique(rolled[first:first + c - width + 1])
            elif c:
                short = (h[first:first + c] * _WEIGHT[:c]).sum(dtype=np.uint64)
                yield mix(np.array([short], np.uint64), 1000 + c)
            else:
                yield np.zeros(0, np.uint64)
            first += c
        at = upto


class MinHash:
    """`count` min-wise hashes (32 bits) of a set, by multiply-add on folded hashes."""

    def __init__(self, count: int, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 1 << 32, count, dtype=np.uint32)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a set; the sets must not be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        at = 0
        while at < len(sets):
            upto, size = at, 0
            while upto < len(sets) and (size < 1 << 16 or upto == at):
                size += len(sets[upto])
                upto += 1
            h = np.concatenate(sets[at:upto])
            x = (h ^ (h >> U(32))).astype(np.uint32)
            offsets = np.cumsum([0, *[len(s) for s in sets[at:upto - 1]]])
            t = np.empty_like(x)
            for i in range(len(self.a)):
                np.multiply(x, self.a[i], out=t)
                t += self.b[i]
                # the low bits of a product are weak: fold the high ones in
                t ^= t >> np.uint32(15)
                out[at:upto, i] = np.minimum.reduceat(t, offsets)
            at = upto
        return out


def jaccard_counts(u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = np.concatenate((u, v))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return inter, len(both) - inter
