"""Kaplan-Meier and survival isotonic distributional regression kernels (numpy).

Inputs are aggregated: `events[j, i]` and `leaves[j, i]` are the weights of
events and of censorings of covariate i at the j-th distinct time, times
ascending.  At a tie events come before censorings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..errors import TooLarge
from .pava import pava

MAX_CHAIN = 600  # covariates of a censored fit: its cost grows with their cube


def km_curve(time: np.ndarray, event: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct event times and the survival right after each."""
    time, event = np.asarray(time), np.asarray(event, bool)
    w = np.ones(len(time)) if weight is None else np.asarray(weight, float)
    keep = w > 0
    time, event, w = time[keep], event[keep], w[keep]
    t, at = np.unique(time, return_inverse=True)
    dead = np.bincount(at, w * event, len(t))
    risk = np.cumsum(np.bincount(at, w, len(t))[::-1])[::-1]
    some = dead > 0
    return t[some], np.cumprod(np.clip(1 - dead[some] / risk[some], 0, 1))


def km_at(time, event, threshold: float, weight=None) -> float:
    """1 - survival at `threshold`: the Kaplan-Meier CDF."""
    t, s = km_curve(time, event, weight)
    k = np.searchsorted(t, threshold, "right")
    return 0.0 if k == 0 else float(1 - s[k - 1])


def clip_triangle(raw: np.ndarray) -> np.ndarray:
    """Recursive clipping of interval values raw[r, s], r <= s, by increasing length.

    Each value is clipped between the largest minimum and the smallest maximum
    that a split of the interval into two clipped ones can give.
    """
    g = len(raw)
    c = raw.copy()
    for length in range(2, g + 1):
        r = np.arange(g - length + 1)
        s = r + length - 1
        k = np.arange(length - 1)
        left = c[r[:, None], r[:, None] + k]
        right = c[r[:, None] + k + 1, s[:, None]]
        low = np.minimum(left, right).max(1)
        high = np.maximum(left, right).min(1)
        c[r, s] = np.clip(raw[r, s], low, high)
    return c


def min_max(table: np.ndarray, decreasing_in_index: bool) -> np.ndarray:
    """min over r <= i of max over s >= i of table[r, s] (decreasing in i), or max of min; NaN cells are left out."""
    outer, inner = (np.fmin, np.fmax) if decreasing_in_index else (np.fmax, np.fmin)
    suffix = inner.accumulate(table[:, ::-1], axis=1)[:, ::-1].copy()
    suffix[np.tril_indices(len(table), -1)] = np.nan
    return outer.reduce(suffix, axis=0)


def interval_cdfs(events: np.ndarray, leaves: np.ndarray) -> Iterator[np.ndarray]:
    """For every time with an event, the KM CDF of every covariate interval [r, s]."""
    g = events.shape[1]
    if g > MAX_CHAIN:
        raise TooLarge(f"{g} covariates: a censored fit takes {MAX_CHAIN} at most; round or bin the covariate")
    both = np.cumsum((events + leaves)[::-1], axis=0)[::-1]  # at risk
    survival = np.ones((g, g))
    edge = lambda row: np.concatenate(([0.0], np.cumsum(row)))
    for j in range(len(events)):
        if not events[j].any():
            continue
        d, n = edge(events[j]), edge(both[j])
        dead, risk = d[None, 1:] - d[:-1, None], n[None, 1:] - n[:-1, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            factor = np.where(risk > 1e-12, 1 - dead / risk, 1.0)
        survival *= np.clip(factor, 0, 1)
        yield 1 - survival


def sidr(events: np.ndarray, leaves: np.ndarray, clip: bool = True, first: int = 0, last: int | None = None) -> np.ndarray:
    """S-IDR CDFs, one row an event time (those numbered first..last-1), decreasing in the covariate."""
    out = []
    for k, raw in enumerate(interval_cdfs(events, leaves)):
        if last is not None and k >= last:
            break
        if k >= first:
            out.append(np.clip(min_max(clip_triangle(raw) if clip else raw, True), 0, 1))
    return np.array(out).reshape(len(out), events.shape[1])


def hazard_uncensored(counts: np.ndarray, weights: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Hazard-rate order: cumulative counts by threshold -> CDFs; thresholds in order."""
    survival = np.ones(len(weights))
    out = []
    for n in counts:
        live = survival > eps
        ratio = pava((1 - n[live] / weights[live]) / survival[live], survival[live] ** 2 * weights[live])
        survival[live] = np.clip(survival[live] * ratio, 0, survival[live])
        survival[~live] = 0
        out.append(1 - survival)
    return np.array(out).reshape(len(out), len(weights))


def hazard_censored(events: np.ndarray, leaves: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Hazard-rate order with censoring: running Kaplan-Meier survival, weighted by what is still at risk."""
    remaining = (events + leaves).sum(0).astype(float)
    risk, own = remaining.copy(), np.ones(len(remaining))
    survival = np.ones(len(remaining))
    out = []
    for d, c in zip(events, leaves):
        if d.any():
            some = remaining > eps
            own[some] *= np.clip(1 - d[some] / remaining[some], 0, 1)
            live = survival > eps
            ratio = np.ones(len(survival))
            ratio[live] = np.clip(pava(own[live] / survival[live], risk[live]), 0, 1)
            survival = np.where(live, survival * ratio, 0)
            risk = risk * np.where(live, ratio, 0)
            out.append(1 - survival)
        remaining = remaining - d
        some = remaining > eps
        risk[some] *= np.clip(1 - c[some] / remaining[some], 0, 1)
        remaining = np.maximum(remaining - c, 0)
    return np.array(out).reshape(len(out), len(remaining))
