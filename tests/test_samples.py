"""Values of ordered samples: many samples at once against each alone."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdfloom.errors import TooLarge
from cdfloom.kernels import functionals
from cdfloom.operators import generic
from cdfloom.queries import QUERIES

row = st.tuples(st.integers(0, 6), st.integers(0, 5), st.booleans(), st.sampled_from([.25, 1, 3]))


def laid_out(samples):
    of = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    x, y, seen, w = (np.array(c) for c in zip(*[r for s in samples for r in sorted(s)]))
    return of, x.astype(float), functionals.Rows.of(y, seen, w)


def clipped_alone(x, rows, functional):
    """By recursion over intervals of the distinct x."""
    u = np.unique(x)
    known = {}

    def value(r, s):
        if (r, s) not in known:
            v = functional(rows[(x >= u[r]) & (x <= u[s])])
            for k in range(r, s):
                a, b = value(r, k), value(k + 1, s)
                if not (np.isnan(a) or np.isnan(b)):
                    v = np.fmax(np.fmin(v, max(a, b)), min(a, b))
            known[r, s] = v
        return known[r, s]

    return value(0, len(u) - 1)


@pytest.mark.parametrize("functional", [functionals.kaplan_meier_at(3.0), functionals.variance, functionals.expected_shortfall(.3)])
@given(samples=st.lists(st.lists(row, min_size=1, max_size=9), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_clipped_values_of_many_samples(functional, samples):
    of, x, rows = laid_out(samples)
    want = [clipped_alone(x[of == b], rows[of == b], functional) for b in range(len(samples))]
    assert np.allclose(functionals.clipped_values(of, x, rows, functional), want, rtol=0, atol=1e-12, equal_nan=True)


def test_samples_are_clipped_together(monkeypatch):
    r = np.random.default_rng(2)
    samples = [[(i, int(r.integers(0, 9)), bool(r.random() < .7), 1) for i in range(n)] for n in r.integers(2, 20, 50)]
    of, x, rows = laid_out(samples)
    calls, clip = [], functionals.clip_lines
    monkeypatch.setattr(functionals, "clip_lines", lambda lines: calls.append(len(lines)) or clip(lines))
    km = functionals.kaplan_meier_at(4.0)
    together = functionals.clipped_values(of, x, rows, km)
    assert len(calls) == 1
    monkeypatch.setattr(functionals, "CELLS", 800)
    assert np.array_equal(functionals.clipped_values(of, x, rows, km), together)
    assert 5 < len(calls) < 50
    monkeypatch.setattr(functionals, "MAX_SAMPLE", 18)
    with pytest.raises(TooLarge):
        functionals.clipped_values(of, x, rows, km)


def key_rows(seed, keys=40):
    """(key, place, y, seen) in random order; keys with a null and with samples of one row."""
    r = np.random.default_rng(seed)
    rows = [(None if k == 3 else f"k{k}", i, float(r.integers(0, 30)), bool(r.random() < .8)) for k in range(keys) for i in range(1 if k % 9 == 0 else int(r.integers(2, 25)))]
    return [rows[i] for i in r.permutation(len(rows))]


@pytest.fixture(params=[(10, 16), (10_000, 20_000)])
def cut(request, spark, monkeypatch):
    """Arrow batches shorter than samples and work of few rows at once; and all at once."""
    batch, held = request.param
    monkeypatch.setattr(generic, "HELD_ROWS", held)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    yield
    spark.conf.set(name, before)


def test_clipped_sample_value_by_keys(spark, cut):
    rows = key_rows(5)
    km = functionals.kaplan_meier_at(12.0)
    out = generic.clipped_sample_value(spark.createDataFrame(rows, "key string, i long, y double, seen boolean"), "y", "i", km, observed="seen", by=["key"])
    got = [tuple(r) for r in out.collect()]
    want = {}
    for key in {r[0] for r in rows}:
        _, i, y, seen = zip(*sorted(r for r in rows if r[0] == key))
        want[key] = clipped_alone(np.array(i), functionals.Rows.of(y, seen), km)
    assert len(got) == len(want) == 40 and {k: pytest.approx(v) for k, v in want.items()} == dict(got)


def test_clipped_sample_value_without_keys(spark):
    rows = [r for r in key_rows(6) if r[0] == "k5"]
    _, i, y, seen = zip(*sorted(rows))
    km = functionals.kaplan_meier_at(12.0)
    out = generic.clipped_sample_value(spark.createDataFrame(rows, "key string, i long, y double, seen boolean"), "y", "i", km, observed="seen")
    assert [tuple(r) for r in out.collect()] == [(pytest.approx(clipped_alone(np.array(i), functionals.Rows.of(y, seen), km)),)]


@pytest.mark.parametrize("name", ["clipped_km", "split_variance"])
def test_small_tables_of_samples_are_spread_over_tasks(spark, data, name):
    """Few bytes of samples are much work: the planner's least bytes a task don't hold for them."""
    assert QUERIES[name](spark, data).select(F.spark_partition_id()).distinct().count() > 1


def split_alone(y):
    """By recursion, with its trace: value, start, end, blocks, largest, smallest."""
    def found(r, s):
        own = (float(np.var(y[r:s], ddof=1)) if s - r > 1 else np.nan, r, s - 1, 1, s - r, s - r)
        if s - r < 4:
            return own
        left = [(found(r, k), s - k) for k in range(r + 2, s - 1)]
        right = [(found(k, s), k - r) for k in range(r + 2, s - 1)]
        parts = [own, *[(v[0], v[1], v[2], v[3] + 1, max(v[4], rest), min(v[5], rest)) for v, rest in left + right]]
        median = sorted(p[0] for p in parts)[len(parts) // 2]
        return next(p for p in parts if p[0] == median)

    return found(0, len(y))


@given(st.lists(st.lists(st.integers(0, 2 ** 20), min_size=1, max_size=9), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_variances_of_splits_of_many_samples(samples):
    of = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    got = functionals.variances_of_splits(of, np.array([float(v) for s in samples for v in s]))
    assert len(got) == len(samples)
    for one, y in zip(got, samples):
        value, *_ = split_alone(np.array(y, float))
        assert one.value == pytest.approx(value, rel=1e-6, abs=1e-2, nan_ok=True)
        assert vars(one) == pytest.approx(vars(functionals.variance_of_splits(np.array(y, float))), nan_ok=True)


def test_samples_are_split_together(monkeypatch):
    r = np.random.default_rng(4)
    samples = [r.random(n) for n in r.integers(1, 12, 30)]
    of = np.repeat(np.arange(30), [len(s) for s in samples])
    calls, medians = [], functionals._split_medians
    monkeypatch.setattr(functionals, "_split_medians", lambda y: calls.append(len(y)) or medians(y))
    got = functionals.variances_of_splits(of, np.concatenate(samples))
    assert calls == [30]
    for one, y in zip(got, samples):
        value, *trace = split_alone(y)
        assert one.value == pytest.approx(value, nan_ok=True) and list(vars(one).values())[1:] == trace
    monkeypatch.setattr(functionals, "CELLS", 300)
    again = functionals.variances_of_splits(of, np.concatenate(samples))
    assert repr(again) == repr(got) and 2 < len(calls) < 31
    monkeypatch.setattr(functionals, "MAX_SAMPLE", 10)
    with pytest.raises(TooLarge):
        functionals.variances_of_splits(of, np.concatenate(samples))


def test_sample_variance_of_splits_by_keys(spark, cut):
    rows = [(k, i, y + i / 64, s) for k, i, y, s in key_rows(7) if i < 12]
    out = generic.sample_variance_of_splits(spark.createDataFrame(rows, "key string, i long, y double, seen boolean"), "y", "i", by=["key"])
    assert out.columns == ["key", "value", "start", "end", "blocks", "largest", "smallest"]
    got = {r["key"]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 40 == out.count()
    for key, (value, *trace) in got.items():
        want, *other = split_alone(np.array([y for _, y in sorted((i, y) for k, i, y, _ in rows if k == key)]))
        assert (value is None and np.isnan(want)) or value == pytest.approx(want)
        assert trace == other
