"""Partial orders: cover edges, exact isotonic means, survival fits (numpy).

`before[i, j]` says that node i precedes node j.  Isotonic values increase
along the order.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from ..errors import NotImplementedCombination, TooLarge
from .survival import km_at

MAX_NODES = 8192
MAX_SETS = 20_000  # lower sets of a censored fit


def dominance(x: np.ndarray) -> np.ndarray:
    """before[i, j]: row i is componentwise at most row j, and they differ."""
    le = (x[:, None, :] <= x[None, :, :]).all(2)
    return le & ~le.T


def cover_edges(before: np.ndarray) -> np.ndarray:
    """Pairs (i, j) with i before j and nothing between."""
    b = before.astype(np.float32)
    return np.argwhere(before & ~((b @ b) > 0))


def closure(n: int, edges: np.ndarray) -> np.ndarray:
    """Reachability over explicit edges (i before j)."""
    reach = np.zeros((n, n), bool)
    for i, j in edges:
        if i != j:
            reach[int(i), int(j)] = True
    while True:
        more = reach | ((reach.astype(np.float32) @ reach.astype(np.float32)) > 0)
        if (more == reach).all():
            return reach
        reach = more


def _best_upper_set(gain: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """The upper set of largest total gain: a maximum closure, by a minimum cut (Dinic).

    Of several such sets, the smallest.
    """
    n = len(gain)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, capacity = [], []

    def arc(a: int, b: int, c: float) -> None:
        head[a].append(len(to))
        to.append(b)
        capacity.append(c)
        head[b].append(len(to))
        to.append(a)
        capacity.append(0.0)

    scale = float(np.abs(gain).sum()) or 1.0
    tiny = 1e-12 * scale
    for i, x in enumerate(gain.tolist()):
        if x > 0:
            arc(source, i, x)
        elif x < 0:
            arc(i, sink, -x)
    for i, j in edges:
        arc(i, j, 2 * scale)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if capacity[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)])
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # augment along the level graph without recursion
            if a == sink:
                c = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= c
                    capacity[e ^ 1] += c
                cut = next(k for k, e in enumerate(path) if capacity[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if capacity[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                at[a] += 1


def isotonic_mean(values: np.ndarray, weights: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Exact weighted least squares under the order, by recursive partitioning.

    A set whose best upper set gains nothing over the set's mean is one level;
    otherwise both parts are solved alone (Spouge, Wan and Wilbur, 2003).
    """
    n = len(values)
    if n > MAX_NODES:
        raise TooLarge(f"{n} nodes: {MAX_NODES} at most")
    values, weights = np.asarray(values, float), np.asarray(weights, float)
    out = np.empty(n)
    work = [np.arange(n)]
    while work:
        at = work.pop()
        w, v = weights[at], values[at]
        total = w.sum()
        mean = float((w * v).sum() / total) if total > 0 else float(v.mean())
        gain = w * (v - mean)
        if len(at) > 1 and np.abs(gain).max() > 1e-12 * max(1.0, np.abs(w * v).max()):
            part = before[np.ix_(at, at)]
            upper = _best_upper_set(gain, [tuple(e) for e in cover_edges(part).tolist()])
            if upper.any() and not upper.all() and gain[upper].sum() > 1e-11 * max(1.0, np.abs(w * v).sum()):
                work += [at[upper], at[~upper]]
                continue
        out[at] = mean
    return out


def partial_idr(counts: np.ndarray, weights: np.ndarray, before: np.ndarray, hazard: bool = False) -> np.ndarray:
    """CDFs by threshold under a partial order, decreasing along it; thresholds in order.

    counts: cumulative event weights, one row a threshold.
    """
    out = []
    survival = np.ones(len(weights))
    for n in counts:
        if not hazard:
            out.append(1 - isotonic_mean(1 - n / weights, weights, before))
            continue
        live = survival > 1e-12
        ratio = isotonic_mean((1 - n[live] / weights[live]) / survival[live], weights[live] * survival[live] ** 2, before[np.ix_(live, live)])
        survival[live] = np.clip(survival[live] * ratio, 0, survival[live])
        survival[~live] = 0
        out.append(1 - survival)
    return np.clip(np.array(out).reshape(len(out), len(weights)), 0, 1)


def _lower_sets(before: np.ndarray, within: int) -> list[int]:
    """All lower sets of the nodes in bit set `within`, as bit sets."""
    nodes = [i for i in range(len(before)) if within >> i & 1]
    nodes.sort(key=lambda i: int(before[:, i].sum()))
    below = {i: sum(1 << int(j) for j in np.flatnonzero(before[:, i])) & within for i in nodes}
    found = {0}
    for i in nodes:  # predecessors come first
        found |= {s | 1 << i for s in found if below[i] & ~s == 0}
        if len(found) > MAX_SETS:
            raise TooLarge(f"more than {MAX_SETS} lower sets: use fewer or more comparable covariates")
    return sorted(found)


def partial_sidr(node: np.ndarray, y: np.ndarray, observed: np.ndarray, weights: np.ndarray, before: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Survival IDR on a poset: recursively clipped KM of convex sets, then extreme lower sets first.

    The CDF decreases along the order, so a lower set of largest value goes first, the smallest of equal ones,
    as the min-max definition on a chain has it.
    """
    n = len(before)
    out = np.empty((len(thresholds), n))
    splits: dict[int, list[int]] = {}

    def lower(a: int) -> list[int]:
        if a not in splits:
            splits[a] = [s for s in _lower_sets(before, a) if s and s != a]
        return splits[a]

    members = [np.flatnonzero(node == i) for i in range(n)]
    for k, z in enumerate(thresholds):
        memo: dict[int, float] = {}

        def value(a: int) -> float:
            if a not in memo:
                rows = np.concatenate([members[i] for i in range(n) if a >> i & 1])
                raw = km_at(y[rows], observed[rows], z, weights[rows])
                low, high = -np.inf, np.inf
                for b in lower(a):
                    u, v = value(b), value(a & ~b)
                    low, high = max(low, min(u, v)), min(high, max(u, v))
                memo[a] = min(max(raw, low), high)
            return memo[a]

        rest = (1 << n) - 1
        while rest:
            best = max([*lower(rest), rest], key=lambda s: (round(value(s), 12), -s.bit_count()))
            for i in range(n):
                if best >> i & 1:
                    out[k, i] = value(best)
            rest &= ~best
    return out


def check_combination(hazard: bool, censored: bool) -> None:
    if hazard and censored:
        raise NotImplementedCombination("hazard-rate order with censoring needs a total order")
