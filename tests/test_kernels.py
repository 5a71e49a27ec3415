"""Golden values worked out by hand, and independent forms held against each other."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cdfloom.errors import NegativeWeights
from cdfloom.kernels import functionals, park, poset, survival
from cdfloom.kernels.pava import chain_fits, pava

T, N = True, False


def counts(x, y, w=None):
    x, y = np.array(x, float), np.array(y, float)
    w = np.ones(len(x)) if w is None else np.array(w, float)
    xs, zs = np.unique(x), np.unique(y)
    return np.array([[w[(x == a) & (y <= z)].sum() for a in xs] for z in zs]), np.array([w[x == a].sum() for a in xs])


def survival_cells(x, y, seen, early=True):
    x, y, seen = np.array(x, float), np.array(y, float), np.array(seen, bool)
    if early:
        keep = seen | (y >= y[seen].min())
        x, y, seen = x[keep], y[keep], seen[keep]
    xs, xi = np.unique(x, return_inverse=True)
    ts, ti = np.unique(y, return_inverse=True)
    events, leaves = np.zeros((len(ts), len(xs))), np.zeros((len(ts), len(xs)))
    np.add.at(events, (ti[seen], xi[seen]), 1)
    np.add.at(leaves, (ti[~seen], xi[~seen]), 1)
    return events, leaves


@pytest.mark.parametrize("y, w, increasing, fitted", [
    ([2, 3, 1, 4, 5], None, True, [2, 2, 2, 4, 5]),
    ([1, 2, 99, 3], [1, 2, 0, 4], False, [17 / 7] * 4),
    ([5, 1], [0, 2], True, [1, 1]),
])
def test_pava(y, w, increasing, fitted):
    assert np.allclose(pava(y, w, increasing), fitted)


def test_negative_weight():
    with pytest.raises(NegativeWeights):
        pava([1, 2], [1, -1])


def test_idr_golden():
    n, w = counts([1, 2, 3, 4, 5], [3, 2, 5, 4, 1])
    a = 1 / 3
    assert np.allclose(chain_fits(n, w, False), [[.2] * 5, [.5, .5, a, a, a], [1, 1, a, a, a], [1, 1, 2 * a, 2 * a, 2 * a], [1] * 5])
    n, w = counts([0, 1, 1, 2, 2, 3, 3, 4, 4], [1, 0, 2, 0, 2, 0, 2, 0, 2], [100, 9, 1, 8, 2, 7, 3, 6, 4])
    assert np.allclose(chain_fits(n, w, False), [[30 / 140] * 5, [1, .9, .8, .7, .6], [1] * 5])


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 3)), min_size=1, max_size=25), st.booleans())
@settings(max_examples=60, deadline=None)
def test_min_max_equals_pooling(rows, increasing):
    n, w = counts(*zip(*rows))
    assert np.allclose(chain_fits(n, w, increasing), [pava(r / w, w, increasing) for r in n])


@pytest.mark.parametrize("x, y, seen, cdf", [
    ([6, 23, 44, 95], [.4, .1, .6, .5], [N, T, T, T], [[.5, .5, 0, 0], [.5] * 4, [1] * 4]),
    ([2, 1, 4, 3], [.5, 4, 1, 0], [T, T, N, T], [[1 / 3] * 3 + [0], [2 / 3] * 3 + [0], [1, 1, 1, 0]]),
    ([0, 1, 2], [0, 1, 2], [N, T, N], [[1, 0]]),
])
def test_sidr_golden(x, y, seen, cdf):
    assert np.allclose(survival.sidr(*survival_cells(x, y, seen)), cdf)


def test_plain_sidr():
    x, y, seen = np.arange(1.0, 5), np.array([2.0, 1, 4, 3]), np.array([N, T, T, T])
    assert np.allclose(functionals.by_definition(x, functionals.Rows.of(y, seen), functionals.kaplan_meier_at(3.5), increasing=False, clip=False)[1], [5 / 8, 5 / 8, .5, .5])


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.booleans()), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_sidr_three_ways(rows):
    x, y, seen = (np.array(c) for c in zip(*rows))
    if not seen.any():
        return
    keep = seen | (y >= y[seen].min())
    x, y, seen = x[keep].astype(float), y[keep].astype(float), seen[keep]
    cdf = survival.sidr(*survival_cells(x, y, seen))
    xs, node = np.unique(x, return_inverse=True)
    z = np.unique(y[seen])
    before = poset.dominance(np.repeat(xs[:, None], 3, 1))
    assert np.allclose(cdf, poset.partial_sidr(node, y, seen, np.ones(len(y)), before, z))
    for t, row in zip(z, cdf):
        assert np.allclose(row, functionals.by_definition(x, functionals.Rows.of(y, seen), functionals.kaplan_meier_at(t), increasing=False)[1])


def test_hazard_golden():
    x, y = [1, 2, 3, 4, 5, 6], [6, 2, 3, 4, 1, 5]
    cdf = survival.hazard_uncensored(*counts(x, y))
    assert np.allclose(cdf[2:5, 0], [25 / 34, 0.9083710407239819, 846499 / 853060])
    cdf = survival.hazard_censored(*survival_cells(x, y, [T] * 6, early=False))
    assert np.allclose(cdf[2:5, 0], [7 / 10, 17 / 20, 37 / 40])


def test_hazard_on_a_chain_poset_equals_the_chain():
    n, w = counts([1, 2, 3, 4, 5, 6], [6, 2, 3, 4, 1, 5])
    before = poset.dominance(np.arange(6.0)[:, None])
    assert np.allclose(poset.partial_idr(n, w, before, hazard=True), survival.hazard_uncensored(n, w))


@pytest.mark.parametrize("v, w, edges, fitted", [
    ([4, 6, 2, 3], [1] * 4, [(0, 1), (0, 2), (1, 3), (2, 3)], [3, 4.5, 3, 4.5]),
    ([8, 7, 0], [1] * 3, [(0, 1), (0, 2)], [4, 7, 4]),
    ([10, 0], [10, 1], [(0, 1)], [100 / 11] * 2),
    ([1, 4, 2, 3], [1] * 4, [(0, 2), (2, 3), (3, 1)], [1, 4, 2, 3]),
    ([1, 2], [1, 1], [(1, 0)], [1.5, 1.5]),
])
def test_poset_mean(v, w, edges, fitted):
    assert np.allclose(poset.isotonic_mean(np.array(v, float), np.array(w, float), poset.closure(len(v), edges)), fitted)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 5), st.integers(1, 3)), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_poset_mean_by_enumeration(rows):
    x, at = np.unique([r[:2] for r in rows], axis=0, return_index=True)
    v, w = np.array([rows[i][2] for i in at], float), np.array([rows[i][3] for i in at], float)
    n, before = len(x), poset.dominance(x)
    full = (1 << n) - 1
    ups = [s for s in range(1, full + 1) if all(not s >> i & 1 or all(s >> int(j) & 1 for j in np.flatnonzero(before[i])) for i in range(n))]
    lows = [full & ~u for u in ups] + [full]
    mean = lambda s: sum(w[k] * v[k] for k in range(n) if s >> k & 1) / sum(w[k] for k in range(n) if s >> k & 1)
    exact = [max(min(mean(u & lo) for lo in lows if lo >> i & 1) for u in ups if u >> i & 1) for i in range(n)]
    assert np.allclose(poset.isotonic_mean(v, w, before), exact)


def test_cover_edges():
    before = poset.dominance(np.array([(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]))
    assert poset.cover_edges(before).tolist() == [[0, 1], [0, 2], [1, 3], [2, 3], [3, 4]]


def test_kaplan_meier():
    t, s = survival.km_curve(np.array([1, 3, 5, 5, 7, 9, 11]), [T, N, T, T, T, N, T])
    assert t.tolist() == [1, 5, 7, 11] and np.allclose(s, [6 / 7, 18 / 35, 12 / 35, 0])


def test_park_of_one_group_is_kaplan_meier():
    y, seen = np.array([1.0, 3, 5, 5, 7, 9, 11]), np.array([T, N, T, T, T, N, T])
    times, cdf = park.fit(np.zeros(7), y, seen, np.array([0.0]), 1e-6)
    for t, c in zip(*survival.km_curve(y, seen)):
        assert abs(cdf[0][times == t][0] - (1 - c)) < 1e-6


def test_park_orders_groups():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 3, 60).astype(float), r.exponential(1, 60)
    _, cdf = park.fit(x, y, r.random(60) < 0.8, np.array([0.0, 1, 2]))
    with np.errstate(invalid="ignore"):
        assert not (np.diff(cdf, axis=0) < -1e-3).any() and not (np.diff(cdf, axis=1) < 0).any()


def test_functionals():
    y, w = np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 2, 1])
    rows = functionals.Rows.of
    assert functionals.average(rows(y, None, w)) == pytest.approx(2.6)
    assert functionals.variance(rows(y)) == pytest.approx(np.var(y, ddof=1))
    assert np.isnan(functionals.variance(rows(y[:1])))
    assert functionals.expected_shortfall(0.5)(rows(y)) == pytest.approx(1.5)
    assert np.isnan(functionals.expected_shortfall(0.1)(rows(y, None, w)))


SEVERAL = [functionals.average, functionals.variance, functionals.expected_shortfall(0.3), functionals.kaplan_meier_at(2.0)]


@pytest.mark.parametrize("functional", SEVERAL)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.booleans(), st.integers(1, 3)), min_size=1, max_size=14))
@settings(max_examples=40, deadline=None)
def test_interval_tables_and_added_up_rows(functional, data):
    """Every interval's value is that of its own rows; rows added up give what they give apart."""
    x, y, seen, w = (np.array(c) for c in zip(*data))
    rows = functionals.Rows.of(y.astype(float), seen, w.astype(float))
    u, table = functionals.interval_table(x, rows, functional)
    for r in range(len(u)):
        for s in range(r, len(u)):
            assert table[r, s] == pytest.approx(functional(rows[(x >= u[r]) & (x <= u[s])]), nan_ok=True, abs=1e-9)
    cells, at = np.unique(np.stack((x, y, seen)), axis=1, return_inverse=True)
    total = lambda v: np.bincount(at.ravel(), v)
    summed = functionals.Rows(cells[1].astype(float), cells[2].astype(bool), total(w), total(w * w), total(np.ones(len(w))))
    assert np.allclose(functionals.interval_table(cells[0], summed, functional)[1], table, equal_nan=True)


def test_blocks_without_a_value():
    """Splits and intervals that have none are passed over: a covariate of one row takes the value of an interval that holds it."""
    rows = functionals.Rows.of
    assert functionals.by_definition(np.array([1.0, 2]), rows([1.0, 3]), functionals.variance)[1].tolist() == [2, 2]
    fitted = functionals.by_definition(np.array([1, 2, 2, 3, 3, 3]), rows([1.0, 2, 4, 3, 9, 5]), functionals.variance)[1]
    assert np.allclose(fitted, [7 / 3, 7 / 3, 28 / 3])
    assert np.isnan(functionals.by_definition(np.array([1.0]), rows([1.0]), functionals.variance)[1]).all()


@pytest.mark.parametrize("low, high, increasing, fitted", [
    (100 + np.arange(11) / 10, np.arange(11.0), True, [.11, 11]), (np.arange(11.0), 100 + np.arange(11) / 10, True, [11, 11]),
])
def test_variance_of_two_groups(low, high, increasing, fitted):
    x = np.repeat([1.0, 2], 11)
    assert np.allclose(functionals.by_definition(x, functionals.Rows.of(np.concatenate((low, high))), functionals.variance, increasing)[1], fitted)


@pytest.mark.parametrize("y, selected", [
    ([-1, 1, -1, 1], (2, 0, 1, 2, 2, 2)), ([0, 0, 100, 0, 0], (2000, 0, 4, 1, 5, 5)), ([3, 3, 4, 4.00000001], (0, 0, 1, 2, 2, 2)),
    ([1, -1, 1, -1 + 1e-2], (1.98005, 2, 3, 2, 2, 2)), ([1, -1, 0, 0], (2 / 3, 0, 3, 1, 4, 4)), ([0, 1], (.5, 0, 1, 1, 2, 2)), ([0, 1, 2], (1, 0, 2, 1, 3, 3)),
])
def test_variance_of_splits(y, selected):
    got = functionals.variance_of_splits(np.array(y, float))
    assert got.value == pytest.approx(selected[0]) and (got.start, got.end, got.blocks, got.largest, got.smallest) == selected[1:]


@given(st.lists(st.integers(-9, 9), min_size=2, max_size=11))
@settings(max_examples=60, deadline=None)
def test_variance_of_splits_by_recursion(y):
    own = lambda r, s: float(np.var(np.array(y[r:s], float), ddof=1))

    def value(r, s):
        parts = [v for k in range(r + 2, s - 1) for v in (value(r, k), value(k, s))] if s - r >= 4 else []
        return sorted([own(r, s), *parts])[len(parts) // 2]

    got = functionals.variance_of_splits(np.array(y, float))
    assert got.value == pytest.approx(value(0, len(y)), abs=1e-9)
    assert got.value == pytest.approx(own(got.start, got.end + 1), abs=1e-9)


def test_clipped_value_of_18_rows():
    y = [16, 9, 17, 7, 10, 8, 2, 13, 15, 1, 14, 3, 11, 12, 4, 18, 6, 5]
    seen = [N, N, N, T, N, T, T, N, N, T, T, T, N, T, N, T, T, T]
    x = np.arange(18)
    rows = functionals.Rows.of(y, seen)
    assert np.allclose(functionals.by_definition(x, rows, functionals.kaplan_meier_at(13.0), increasing=False)[1], 24 / 49)
    table = functionals.interval_table(x, rows, functionals.kaplan_meier_at(13.0))[1]
    assert functionals.clipped_value(x, rows, functionals.kaplan_meier_at(13.0)) == pytest.approx(functionals.clip_in_turn(table)[0, -1])
    assert np.allclose(np.triu(functionals.clip_in_turn(table)), np.triu(survival.clip_triangle(table)))


def test_park_counts_equal_rows():
    r = np.random.default_rng(3)
    x, y, seen = r.integers(0, 9, 200).astype(float), np.round(r.exponential(5, 200)), r.random(200) < .7
    cells, count = np.unique(np.stack((x, y, seen)), axis=1, return_counts=True)
    times, cdf = park.fit(x, y, seen, np.array([1.0, 4, 8]))
    again = park.fit(cells[0], cells[1], cells[2].astype(bool), np.array([1.0, 4, 8]), count=count)
    assert np.array_equal(times, again[0]) and np.allclose(cdf, again[1], equal_nan=True)
    u, k = np.unique(x, return_counts=True)
    assert np.allclose(park.default_centres(x), park.default_centres(u, k))
