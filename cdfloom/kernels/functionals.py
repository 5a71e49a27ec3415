"""Block aggregates for generic isotonic regression, and values of ordered samples (numpy)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

from ..errors import TooLarge
from .survival import interval_cdfs, km_at, min_max

MAX_SAMPLE = 600  # rows of an ordered sample whose intervals are all looked at: the cost grows with their cube
CELLS = 250_000  # intervals of samples that are worked on together; one sample may have more


@dataclass(frozen=True)
class Rows:
    """Rows of a block; equal ones may be added up: weight w, sum of squared weights ww, number k."""

    y: np.ndarray
    observed: np.ndarray
    w: np.ndarray
    ww: np.ndarray
    k: np.ndarray

    @classmethod
    def of(cls, y, observed=None, w=None) -> Rows:
        """Rows that are not added up."""
        y = np.asarray(y, float)
        w = np.ones(len(y)) if w is None else np.asarray(w, float)
        return cls(y, np.ones(len(y), bool) if observed is None else np.asarray(observed, bool), w, w * w, np.ones(len(y)))

    def __getitem__(self, at) -> Rows:
        return Rows(self.y[at], self.observed[at], self.w[at], self.ww[at], self.k[at])

    def __add__(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(c) for c in zip(self._all(), other._all())))

    def _all(self) -> tuple[np.ndarray, ...]:
        return self.y, self.observed, self.w, self.ww, self.k


#: The value of a block; NaN where it has none.
Functional = Callable[[Rows], float]


@dataclass(frozen=True)
class Moments:
    """A functional of a block's (k, w, ww, mean, sum of squared deviations), for blocks and, from prefix sums, for all intervals."""

    value: Callable[..., np.ndarray]

    def __call__(self, rows: Rows) -> float:
        w = rows.w.sum()
        mean = (rows.w * rows.y).sum() / w if w > 0 else math.nan
        with np.errstate(invalid="ignore", divide="ignore"):
            return float(self.value(rows.k.sum(), w, rows.ww.sum(), mean, (rows.w * (rows.y - mean) ** 2).sum()))

    def table(self, at: np.ndarray, g: int, rows: Rows) -> np.ndarray:
        centre = float((rows.w * rows.y).sum() / rows.w.sum()) if rows.w.sum() > 0 else 0.0
        y = rows.y - centre  # what is squared is small
        edges = [np.concatenate(([0.0], np.cumsum(np.bincount(at, v, g)))) for v in (rows.k, rows.w, rows.ww, rows.w * y, rows.w * y * y)]
        k, w, ww, m1, m2 = (e[None, 1:] - e[:-1, None] for e in edges)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(w > 0, m1 / w, np.nan)
            return self.value(k, w, ww, mean + centre, np.maximum(m2 - mean * m1, 0.0))


average = Moments(lambda k, w, ww, mean, ss: mean)


def _variance(k, w, ww, mean, ss):
    free = w - ww / w
    return np.where((k >= 2) & (free > 0), ss / free, np.nan)


#: Reliability-weighted sample variance; NaN for fewer than two rows.
variance = Moments(_variance)


def expected_shortfall(alpha: float) -> Functional:
    """Mean of the lower `alpha` mass; NaN for fewer than ceil(1 / alpha) rows."""
    def of(rows: Rows) -> float:
        if rows.k.sum() < math.ceil(1 / alpha):
            return math.nan
        order = np.argsort(rows.y, kind="stable")
        mass = rows.w[order]
        cut = alpha * mass.sum()
        used = np.clip(cut - (np.cumsum(mass) - mass), 0, mass)
        return float((used * rows.y[order]).sum() / cut)
    return of


@dataclass(frozen=True)
class KaplanMeierAt:
    """The Kaplan-Meier CDF at a threshold."""

    threshold: float

    def __call__(self, rows: Rows) -> float:
        return km_at(rows.y, rows.observed, self.threshold, rows.w)

    def table(self, at: np.ndarray, g: int, rows: Rows) -> np.ndarray:
        t, ti = np.unique(rows.y, return_inverse=True)
        events, leaves = np.zeros((len(t), g)), np.zeros((len(t), g))
        np.add.at(events, (ti[rows.observed], at[rows.observed]), rows.w[rows.observed])
        np.add.at(leaves, (ti[~rows.observed], at[~rows.observed]), rows.w[~rows.observed])
        out = np.zeros((g, g))
        times = t[events.any(1)]
        for z, out_now in zip(times, interval_cdfs(events, leaves)):
            if z > self.threshold:
                break
            out = out_now
        return out

    def lines(self, of: np.ndarray, at: np.ndarray, places: np.ndarray, rows: Rows) -> list[np.ndarray]:
        """`table` of several samples, as `interval_lines` has it."""
        b, g = len(places), int(places.max())
        t, ti = np.unique(rows.y, return_inverse=True)
        key = of * len(t) + ti
        dies = rows.observed & (rows.y <= self.threshold)
        times = np.unique(key[dies])  # of each sample, in turn
        upto = np.searchsorted(times, key, "right") - np.searchsorted(times, np.arange(b) * len(t))[of]  # its sample's times that a row reaches
        steps = int(upto.max())
        cell = ((upto - 1) * g + at) * b + of
        count = lambda some: np.bincount(cell[some], rows.w[some], steps * g * b).reshape(steps, g, b)
        both = np.cumsum(count(upto > 0)[::-1], axis=0)[::-1]  # at risk
        d, n = np.zeros((2, steps, g + 1, b))
        np.cumsum(count(dies), axis=1, out=d[:, 1:])
        np.cumsum(both, axis=1, out=n[:, 1:])
        out = []
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(g):
                survival = np.ones((g - k, b))
                factor, risk = np.empty((2, g - k, b))
                for j in range(steps):
                    np.subtract(d[j, k + 1:], d[j, :g - k], out=factor)
                    np.subtract(n[j, k + 1:], n[j, :g - k], out=risk)
                    np.divide(factor, risk, out=factor)
                    np.subtract(1, factor, out=factor)
                    np.copyto(factor, 1.0, where=risk <= 1e-12)
                    np.maximum(factor, 0, out=factor)
                    np.minimum(factor, 1, out=factor)
                    survival *= factor
                out.append(1 - survival)
        return out


kaplan_meier_at = KaplanMeierAt


def pooled(x, rows: Rows, functional: Functional, increasing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators with any block aggregate: distinct x and fitted values.

    Blocks without a value are pooled with the one before.
    """
    u, at = np.unique(x, return_inverse=True)
    order = np.argsort(at, kind="stable")
    sign = 1 if increasing else -1
    stack: list[tuple[float, Rows, int]] = []
    for mine in np.split(order, np.cumsum(np.bincount(at))[:-1]):
        block, size = rows[mine], 1
        value = functional(block)
        while stack and (math.isnan(stack[-1][0]) or math.isnan(value) or sign * stack[-1][0] > sign * value):
            _, before, k = stack.pop()
            block, size = before + block, size + k
            value = functional(block)
        stack.append((value, block, size))
    return u, np.repeat([s[0] for s in stack], [s[2] for s in stack])


def interval_table(x, rows: Rows, functional: Functional) -> tuple[np.ndarray, np.ndarray]:
    """Distinct x and the functional of every interval [r, s] of them, r <= s."""
    u, at = np.unique(x, return_inverse=True)
    g = len(u)
    if hasattr(functional, "table"):
        table = functional.table(at, g, rows)
        table[np.tril_indices(g, -1)] = np.nan
        return u, table
    # a running sum over one dense axis of distinct (y, observed): no interval's rows are copied together
    kinds, kind = np.unique(np.stack((rows.y, rows.observed.astype(float))), axis=1, return_inverse=True)
    cells = np.zeros((3, g, kinds.shape[1]))
    for c, v in zip(cells, (rows.w, rows.ww, rows.k)):
        np.add.at(c, (at, kind.ravel()), v)
    y, seen = kinds[0], kinds[1].astype(bool)
    table = np.full((g, g), np.nan)
    for r in range(g):
        running = np.zeros((3, kinds.shape[1]))
        for s in range(r, g):
            running += cells[:, s]
            some = running[2] > 0
            table[r, s] = functional(Rows(y[some], seen[some], *running[:, some]))
    return u, table


def clip_in_turn(raw: np.ndarray) -> np.ndarray:
    """Recursive clipping of interval values raw[r, s] by increasing length, for functionals of any kind.

    A value moves into the range of the two parts of each split in turn, from the
    left; a split with an unknown part is passed over.  Where the ranges of all
    splits meet, this is `clip_triangle`.
    """
    g = len(raw)
    c = raw.copy()
    for k, line in enumerate(clip_lines([np.diagonal(raw, k)[:, None].copy() for k in range(g)])):
        r = np.arange(g - k)
        c[r, r + k] = line[:, 0]
    return c


def clip_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """`clip_in_turn` of several samples, in place: lines[k][r, b] is the value of [r, r + k] in sample b."""
    for k in range(1, len(lines)):
        now = lines[k]
        low, high = np.empty_like(now), np.empty_like(now)
        for j in range(k):
            left, right = lines[j][: len(now)], lines[k - 1 - j][j + 1:]
            np.minimum(left, right, out=low)  # NaN if either is, as high is: the value stays then
            np.maximum(left, right, out=high)
            np.fmin(now, high, out=now)
            np.fmax(now, low, out=now)
    return lines


def by_definition(x, rows: Rows, functional: Functional, increasing: bool = True, clip: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All intervals, clipped by increasing length, then max-min (increasing) or min-max.

    Intervals without a value (NaN) are left out; where all that hold a covariate lack one, its value is NaN.
    """
    u, table = interval_table(x, rows, functional)
    return u, min_max(clip_in_turn(table) if clip else table, not increasing)


# ---- values of an ordered sample ----

def _bounded(n: int) -> None:
    if n > MAX_SAMPLE:
        raise TooLarge(f"{n} rows of a sample: {MAX_SAMPLE} at most; use keys (by) or sum up")


def _together(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of all samples, those of like sizes together, at most CELLS intervals (or one sample) at a time."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * int(sizes[order[i]]) ** 2 > CELLS:
            yield order[start:i]
            start = i


def interval_lines(of: np.ndarray, at: np.ndarray, places: np.ndarray, rows: Rows, functional: Functional) -> list[np.ndarray]:
    """lines[k][r, b]: the functional of the places [r, r + k] of sample b; what lies beyond a sample's places has no meaning.

    of, at: the sample and place of each row; places: their number in each sample.
    """
    if hasattr(functional, "lines"):
        return functional.lines(of, at, places, rows)
    lines = [np.full((places.max() - k, len(places)), np.nan) for k in range(places.max())]
    for b, n in enumerate(places):
        mine = of == b
        _, table = interval_table(at[mine], rows[mine], functional)
        for k in range(n):
            lines[k][: n - k, b] = np.diagonal(table, k)
    return lines


def clipped_values(of: np.ndarray, x: np.ndarray, rows: Rows, functional: Functional) -> np.ndarray:
    """The functional of each whole ordered sample, clipped recursively by its parts (the distinct x).

    Rows lie in order of their sample's number `of` (0, 1, ...) and x.
    """
    start = np.searchsorted(of, np.arange(of[-1] + 1))
    new = np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1]))
    place = np.cumsum(new) - 1
    at = place - place[start][of]
    places = np.diff(np.append(place[start], place[-1] + 1))
    _bounded(int(places.max()))
    out = np.empty(len(places))
    number = np.full(len(places), -1)
    for some in _together(places):
        number[:] = -1
        number[some] = np.arange(len(some))
        mine = number[of] >= 0
        lines = clip_lines(interval_lines(number[of[mine]], at[mine], places[some], rows[mine], functional))
        out[some] = [lines[n - 1][0, b] for b, n in enumerate(places[some])]
    return out


def clipped_value(x, rows: Rows, functional: Functional) -> float:
    """`clipped_values` of one sample, whose rows may lie in any order."""
    order = np.argsort(x, kind="stable")
    return float(clipped_values(np.zeros(len(order), int), np.asarray(x)[order], rows[order], functional)[0])


@dataclass(frozen=True)
class Selected:
    """value; start, end: first and last row of the interval whose own variance it is; blocks, largest, smallest:
    number and extreme sizes of the parts that the splits on the way there leave."""

    value: float
    start: int
    end: int
    blocks: int
    largest: int
    smallest: int


def variances_of_splits(of: np.ndarray, y: np.ndarray) -> list[Selected]:
    """The variance of each ordered sample as a median over splits, and where it comes from.

    By increasing length from 4: the value of an interval is the median of its
    own sample variance and of the values of both parts of every split into
    parts of two rows at least.  Of equal candidates the own variance comes
    first, then left parts, then right parts, each by the place of the split.
    Rows lie in order of their sample's number `of` (0, 1, ...).
    """
    start = np.searchsorted(of, np.arange(of[-1] + 1))
    size = np.diff(np.append(start, len(of)))
    _bounded(int(size.max()))
    out = np.empty(len(size), object)
    for some in _together(size):
        padded = np.zeros((len(some), size[some].max()))
        for row, b in zip(padded, some):
            row[: size[b]] = y[start[b] : start[b] + size[b]]
        value, s1, s2 = _split_medians(padded)
        for i, b in enumerate(some):
            out[b] = _selected(value[i], s1[i], s2[i], int(size[b]))
    return out.tolist()


def variance_of_splits(y: np.ndarray) -> Selected:
    """`variances_of_splits` of one sample."""
    y = np.asarray(y, float)
    return variances_of_splits(np.zeros(len(y), int), y)[0] if len(y) else Selected(math.nan, 0, 0, 1, 0, 0)


def _variance_of(t1, t2, size):
    """From the sums of the values and of their squares."""
    return (t2 - t1 * t1 / size) / (size - 1)


def _split_medians(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value[b, r, s] of the rows [r, s] of each sample y[b], and the running sums of its values and of their squares."""
    b, n = y.shape
    s1, s2 = (np.concatenate((np.zeros((b, 1)), np.cumsum(v, 1)), 1) for v in (y, y * y))
    size = np.arange(1, n + 1)[None, :] - np.arange(n)[:, None]
    t1, t2 = (s[:, None, 1:] - s[:, :-1, None] for s in (s1, s2))
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(size >= 2, _variance_of(t1, t2, size), np.nan)
    turned = value.transpose(0, 2, 1).copy()  # [b, s, r]: right parts lie side by side as well
    step = value.strides[0], (n + 1) * value.itemsize, value.itemsize  # sample, next interval of the same length, next split
    for length in range(4, n + 1):
        splits = length - 3
        shape = b, n - length + 1, splits
        parts = np.empty((*shape[:2], 2 * splits + 1))
        own, same = as_strided(value[:, 0, length - 1:], shape[:2], step[:2]), as_strided(turned[:, length - 1], shape[:2], step[:2])
        parts[..., 0] = own
        parts[..., 1 : splits + 1] = as_strided(value[:, 0, 1:], shape, step)
        parts[..., splits + 1:] = as_strided(turned[:, length - 1, 2:], shape, step)
        parts.partition(splits, axis=-1)
        own[...] = same[...] = parts[..., splits]
    return value, s1, s2


def _selected(value: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: int) -> Selected:
    """The way from the whole sample of n rows down to the interval whose own variance is its value."""
    if n < 2:
        return Selected(math.nan, 0, 0, 1, n, n)
    r, s, others = 0, n - 1, []
    found = value[r, s]
    while s - r >= 3 and _variance_of(s1[s + 1] - s1[r], s2[s + 1] - s2[r], s - r + 1) != found:
        at = np.flatnonzero(np.concatenate((value[r, r + 1 : s - 1], value[r + 2 : s, s])) == found)
        if not len(at):  # NaN
            break
        k = r + 1 + int(at[0]) % (s - r - 2)  # last row of the left part
        if at[0] < s - r - 2:
            others.append(s - k)
            s = k
        else:
            others.append(k - r + 1)
            r = k + 1
    sizes = [s - r + 1, *others]
    return Selected(float(found), r, s, len(sizes), max(sizes), min(sizes))
