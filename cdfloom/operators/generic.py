"""Isotonic regression of any block aggregate, survival variants at one threshold, and values of ordered samples.

Rows that are equal in keys, covariate, response and indicator are added up on
the map side before a kernel sees them, so a task holds distinct values, not
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import functionals as K
from .prep import Roles, drop_early_censored, plain, validate

TASK_ROWS = 25_000  # of ordered samples a task, on average: they are small in bytes and long in work, so sizes don't tell how to cut them
HELD_ROWS = 20_000  # of ordered samples that are worked on together, or one sample


def _summed(df: DataFrame, y: str, x: str, observed: str | None, weight: str | None, by: list[str]) -> DataFrame:
    """by..., x0, y, observed, w, ww, k: equal rows added up; rows of weight zero go."""
    rows = plain(df, Roles(y, [x], observed, weight, by))
    validate(rows, 1)
    return _added_up(rows, by)


def _added_up(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.where("w > 0").groupBy(*by, "x0", "y", "observed")
    return sums.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count("*").cast("double").alias("k"))


def _solved(rows: DataFrame, by: list[str], solve, schema_tail: str) -> DataFrame:
    """by... and what `solve(x, Rows)` returns (a pandas frame) for each group's rows, sorted."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x0", "y", "observed"], ascending=[True, True, False], kind="stable")
        column = lambda c: pdf[c].to_numpy()
        out = solve(column("x0"), K.Rows(column("y"), column("observed").astype(bool), column("w"), column("ww"), column("k")))
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], schema_tail])
    grouped = rows.groupBy(*by) if by else rows.groupBy(F.lit(0).alias("__g"))
    columns = [*by, *[c.split()[0] for c in schema_tail.split(", ")]]
    return grouped.applyInPandas(lambda pdf: run(pdf)[columns], schema)


def isotonic_functional(df: DataFrame, y: str, x: str, functional: K.Functional, observed=None, weight=None, by=None, increasing=True, definition=False, clip=True) -> DataFrame:
    """by..., x, fitted: pooling of adjacent violators, or max-min over all intervals (`definition`).

    fitted is null where no block that holds x has a value.
    """
    def solve(xs, rows):
        u, f = K.by_definition(xs, rows, functional, increasing, clip) if definition else K.pooled(xs, rows, functional, increasing)
        return pd.DataFrame({"x": u, "fitted": f})
    by = by or []
    out = _solved(_summed(df, y, x, observed, weight, by), by, solve, "x double, fitted double")
    return out.withColumn("fitted", F.nanvl("fitted", F.lit(None).cast("double")))


def survival_threshold(df: DataFrame, threshold: float, y: str, x: str, observed: str, weight=None, by=None, decreasing: bool = True, plain_form: bool = False) -> DataFrame:
    """by..., x, cdf: S-IDR at one threshold; `decreasing` is the direction of the CDF in x.

    plain_form: without recursive clipping.
    """
    def solve(xs, rows):
        u, f = K.by_definition(xs, rows, K.kaplan_meier_at(threshold), not decreasing, not plain_form)
        return pd.DataFrame({"x": u, "cdf": np.clip(f, 0, 1)})
    by = by or []
    rows = _summed(df, y, x, observed, weight, by)
    return _solved(rows if plain_form else drop_early_censored(rows, by), by, solve, "x double, cdf double")


def plain_sidr(df: DataFrame, y: str, x: str, observed: str, weight=None, by=None) -> DataFrame:
    """by..., x, threshold, cdf at all event times: S-IDR without recursive clipping."""
    from ..kernels.survival import sidr

    def solve(xs, rows):
        u, xi = np.unique(xs, return_inverse=True)
        t, ti = np.unique(rows.y, return_inverse=True)
        events, leaves = np.zeros((len(t), len(u))), np.zeros((len(t), len(u)))
        seen = rows.observed
        np.add.at(events, (ti[seen], xi[seen]), rows.w[seen])
        np.add.at(leaves, (ti[~seen], xi[~seen]), rows.w[~seen])
        times = t[events.any(1)]
        cdf = sidr(events, leaves, clip=False)
        return pd.DataFrame({"x": np.tile(u, len(times)), "threshold": np.repeat(times, len(u)), "cdf": cdf.ravel()})
    by = by or []
    return _solved(_summed(df, y, x, observed, weight, by), by, solve, "x double, threshold double, cdf double")


def _by_samples(rows: DataFrame, n: int, by: list[str], columns: list[str], solve, schema_tail: str) -> DataFrame:
    """by... and the columns of `solve(of, *columns)` for the ordered samples of all keys; about n rows.

    A task takes samples of many keys at once: of numbers them from 0, and their
    rows are sorted by x0, y and observed rows first.
    """
    order = ["x0", "y", *([F.desc("observed")] if "observed" in columns else [])]
    if by:
        # an exchange of the planner's own number would be dropped after one like it, which may be merged by its bytes
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, math.ceil(n / TASK_ROWS))
        rows = rows.repartition(tasks, *by)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    names = [c.split()[0] for c in schema_tail.split(", ")]
    enough = HELD_ROWS

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        starts = table["__first"].to_numpy()
        found = solve(np.cumsum(starts) - 1, *[table[c].to_numpy() for c in columns])
        keys = table.select(by).take(np.flatnonzero(starts))
        yield from pa.table([*keys.columns, *[pa.array(found[c]) for c in names]], [*by, *names]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            if len(starts) and size + starts[-1] >= enough:
                yield from solved([*held, batch.slice(0, starts[-1])])
                batch = batch.slice(starts[-1])
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from solved(held)

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], schema_tail])
    return rows.select(*by, *columns, first.alias("__first")).mapInArrow(run, schema)


def clipped_sample_value(df: DataFrame, y: str, order_by: str, functional: K.Functional, observed=None, weight=None, by=None) -> DataFrame:
    """by..., value: a functional of each ordered sample, clipped recursively by its parts; samples are small (MAX_SAMPLE).

    Rows of one place in the order are one part.
    """
    def solve(of, x, y, seen, w, ww, k):
        return {"value": K.clipped_values(of, x, K.Rows(y, seen, w, ww, k), functional)}
    by = by or []
    rows = plain(df, Roles(y, [order_by], observed, weight, by))
    n = validate(rows, 1)["n"]
    out = _by_samples(_added_up(rows, by), n, by, ["x0", "y", "observed", "w", "ww", "k"], solve, "value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def sample_variance_of_splits(df: DataFrame, y: str, order_by: str, by: list[str] | None = None) -> DataFrame:
    """by..., value, start, end, blocks, largest, smallest: the median-of-splits variance of each ordered sample, with its trace.

    A row is a member of the sample; rows of one place are ordered by y.  value is null for one row.
    """
    by = by or []
    rows = plain(df, Roles(y, [order_by], None, None, by))
    n = validate(rows, 1)["n"]
    names = ["value", "start", "end", "blocks", "largest", "smallest"]

    def solve(of, _x, y):
        found = [[getattr(one, c) for c in names] for one in K.variances_of_splits(of, y)]
        return {c: np.array(v) for c, v in zip(names, zip(*found))}

    out = _by_samples(rows, n, by, ["x0", "y"], solve, "value double, start long, end long, blocks long, largest long, smallest long")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
