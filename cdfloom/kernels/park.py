"""Constrained nonparametric maximum likelihood for ordered survival functions (Park, Taylor and Kalbfleisch, 2012).

Survival is larger in earlier groups, S_1 >= S_2 >= ..., so the CDF increases with the group.
"""

from __future__ import annotations

import math

import numpy as np


def _quantiles(x: np.ndarray, count: np.ndarray, q) -> np.ndarray:
    """Linear quantiles of sorted distinct x that occur `count` times each."""
    upto = np.cumsum(count)
    at = np.asarray(q) * (upto[-1] - 1)
    low, high = (x[np.searchsorted(upto, f(at), "right")] for f in (np.floor, np.ceil))
    return low + (at - np.floor(at)) * (high - low)


def default_centres(x: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """Evenly spaced quantiles, as many as a Silverman bandwidth fits into the range; x may occur `count` times each."""
    x, at = np.unique(np.asarray(x, float), return_inverse=True)
    count = np.bincount(at, count).astype(float)
    n = count.sum()
    mean = (count * x).sum() / n
    spread = math.sqrt((count * (x - mean) ** 2).sum() / (n - 1)) if n > 1 else 0.0
    iqr = float(np.subtract(*_quantiles(x, count, [0.75, 0.25]))) / 1.34
    scale = min(s for s in (spread, iqr) if s > 0) if max(spread, iqr) > 0 else 0.0
    width = 0.9 * scale * n ** -0.2
    k = 1 if width <= 0 else max(1, math.ceil((x[-1] - x[0]) / (2 * width)))
    return np.unique(_quantiles(x, count, (np.arange(k) + 0.5) / k))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre; ties go left."""
    right = np.clip(np.searchsorted(centres, x, "left"), 0, len(centres) - 1)
    left = np.maximum(right - 1, 0)
    return np.where(x - centres[left] <= centres[right] - x, left, right)


class _Group:
    def __init__(self, time: np.ndarray, event: np.ndarray, count: np.ndarray) -> None:
        self.all, at = np.unique(time, return_inverse=True)
        dead = np.bincount(at, event * count, len(self.all))
        self.left = np.append(np.cumsum(np.bincount(at, count, len(self.all))[::-1])[::-1], 0.0)  # at risk at each time
        some = dead > 0
        self.time, self.dead, self.risk = self.all[some], dead[some], self.left[:-1][some]

    def at_risk(self, t: float) -> float:
        return float(self.left[np.searchsorted(self.all, t, "left")])

    def log_survival(self, t: float) -> float:
        k = np.searchsorted(self.time, t, "right")
        with np.errstate(divide="ignore"):
            return float(np.log1p(-self.dead[:k] / self.risk[:k]).sum()) if k else 0.0

    def multiplier(self, q: float, t: float, epsilon: float) -> float:
        """K(q, t): the shift of the risk sets under which the log survival at t is q."""
        n = self.at_risk(t)
        if n == 0:
            return 0.0
        k = int(np.searchsorted(self.time, t, "right"))
        if k == 0:
            return -float(n)
        if q >= 0:
            return math.inf
        d, r = self.dead[:k], self.risk[:k]

        def value(shift: float) -> float:
            with np.errstate(divide="ignore", invalid="ignore"):
                inner = 1 - d / (r + shift)
            return -math.inf if (inner <= 0).any() else float(np.log(inner).sum())

        low, high = float((d - r).max()), 1.0
        while value(high) < q:
            high *= 2
            if high > 1e15:
                return math.inf
        while high - low > epsilon * 1e-3 * max(1.0, abs(high)):
            mid = (low + high) / 2
            low, high = (mid, high) if value(mid) < q else (low, mid)
        return max(-float(n), (low + high) / 2)


def _pooled(groups: list[_Group], t: float, epsilon: float) -> float:
    """q with the sum of the multipliers zero; 0 if no group had an event."""
    if not any(len(g.time) and g.time[0] <= t for g in groups):
        return 0.0
    finite = [v for g in groups if math.isfinite(v := g.log_survival(t))]
    low, high = min([*finite, -1.0]) - 1.0, 0.0
    total = lambda q: sum(g.multiplier(q, t, epsilon) for g in groups)
    while total(low) > 0 and low > -60:
        low *= 2
    while high - low > epsilon * 1e-2:
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(x: np.ndarray, y: np.ndarray, observed: np.ndarray, centres: np.ndarray, epsilon: float = 1e-4, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Times and CDFs (group x time); NaN where a group has nobody at risk any more.  A row may stand for `count` equal ones."""
    y, observed = np.asarray(y, float), np.asarray(observed, bool)
    count = np.ones(len(y)) if count is None else np.asarray(count, float)
    of = nearest(np.asarray(x, float), centres)
    groups = [_Group(y[of == k], observed[of == k], count[of == k]) for k in range(len(centres))]
    times = np.unique(np.concatenate((y[observed], np.nextafter(y[~observed], np.inf))))
    cdf = np.full((len(centres), len(times)), np.nan)
    for j, t in enumerate(times):
        active = [k for k, g in enumerate(groups) if g.at_risk(t) > 0]
        stack: list[tuple[float, list[int]]] = []
        for k in active:
            q, block = groups[k].log_survival(t), [k]
            while stack and stack[-1][0] < q:
                block = stack.pop()[1] + block
                q = _pooled([groups[i] for i in block], t, epsilon)
            stack.append((q, block))
        for q, block in stack:
            cdf[block, j] = np.clip(1 - math.exp(q), 0, 1)
    cdf = np.maximum.accumulate(cdf, axis=1)  # NaN stays
    for axis in (1, 0):
        done = np.logical_or.accumulate(cdf == 1.0, axis=axis)
        cdf[done] = 1.0
    return times, cdf
