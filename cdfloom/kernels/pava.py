"""Isotonic mean regression on a chain (numpy)."""

from __future__ import annotations

import numpy as np

from ..errors import NegativeWeights

MIN_MAX_CELLS = 4_000_000  # above this many (threshold, r, s) cells the loop takes over


def pava(values: np.ndarray, weights: np.ndarray | None = None, increasing: bool = True) -> np.ndarray:
    """Weighted least squares fit that is monotone in the index.

    Blocks are pooled on strict violation.  An item of weight zero takes the
    value of the block to its left, leading ones that of the first block; if
    all weights are zero the values come back as they are.
    """
    v = np.asarray(values, float)
    w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
    if (w < 0).any() or np.isnan(w).any():
        raise NegativeWeights("weights must be at least 0")
    some = np.flatnonzero(w > 0)
    if not len(some):
        return v.copy()
    sign = 1.0 if increasing else -1.0
    mean, mass, size = [], [], []
    for x, m in zip((sign * v[some]).tolist(), w[some].tolist()):
        k = 1
        while mean and mean[-1] > x:
            total = mass[-1] + m
            x = (mean.pop() * mass[-1] + x * m) / total
            mass.pop()
            m, k = total, k + size.pop()
        mean.append(x)
        mass.append(m)
        size.append(k)
    fitted = sign * np.repeat(mean, size)
    at = np.searchsorted(some, np.arange(len(v)), "right") - 1
    return fitted[np.maximum(at, 0)]


def chain_fits(counts: np.ndarray, weights: np.ndarray, increasing: bool) -> np.ndarray:
    """Row-wise monotone fits of counts / weights: one row a threshold, one column a covariate.

    Short chains use the closed min-max form for all rows at once.
    """
    t, g = counts.shape
    if t * g * g > MIN_MAX_CELLS or g == 1:
        return np.stack([pava(row / weights, weights, increasing) for row in counts]) if t else np.zeros((0, g))
    cn = np.concatenate((np.zeros((t, 1)), np.cumsum(counts, 1)), 1)
    cw = np.concatenate(([0.0], np.cumsum(weights)))
    out = np.empty((t, g))
    worse, better = (np.maximum, np.minimum) if increasing else (np.minimum, np.maximum)
    # m[r] over s >= i, then the extreme over r <= i
    with np.errstate(invalid="ignore", divide="ignore"):
        table = (cn[:, None, 1:] - cn[:, :-1, None]) / (cw[None, None, 1:] - cw[None, :-1, None])
    fill = np.inf if increasing else -np.inf
    r, s = np.tril_indices(g, -1)
    table[:, r, s] = fill
    suffix = better.accumulate(table[:, :, ::-1], axis=2)[:, :, ::-1]  # over s >= i
    suffix[:, r, s] = -fill
    for i in range(g):
        out[:, i] = worse.reduce(suffix[:, : i + 1, i], axis=1)
    return out
