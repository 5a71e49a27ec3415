"""Isotonic distributional regression: fit, model, queries."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import ConfigParseError, CovariateDimensionMismatch, OrderMismatch, ShapeMismatch, SubaggingParameterInconsistency
from .functions import cdf as C
from .kernels import poset, survival
from .kernels.pava import chain_fits
from .operators.prep import CovariateOrder, Roles, aggregated, drop_early_censored, plain, thresholds, validate
from .plans import sqlform
from .plans.asof import asof_both
from .plans.lineage import cut
from .plans.offsets import with_offsets

SQL_COVARIATES = 64  # longest chain that is fitted as a Catalyst plan
BLOCK_CELLS = 4_000_000  # threshold x covariate cells of a task
Y_ORDERS = ("sd", "hazard")


@dataclass(frozen=True)
class Meta:
    x: list[str]
    by: list[str] = field(default_factory=list)
    total: bool = True
    increasing: bool = True
    y_order: str = "sd"
    groups: list = field(default_factory=list)
    subsamples: int = 1


class IDRModel:
    """cdfs: by..., subsample_id, at (array of covariates as compared), cdf (array).  grid: by..., thresholds.
    global_cdf (partial orders): by..., cdf for covariates comparable to none."""

    def __init__(self, cdfs: DataFrame, grid: DataFrame, meta: Meta, global_cdf: DataFrame | None = None, fitted: bool = True) -> None:
        self.cdfs, self.grid, self.meta, self.global_cdf, self.fitted = cdfs, grid, meta, global_cdf, fitted

    def settle(self) -> IDRModel:
        """Runs a fit that is still a plan, once, and keeps it in the shared folder: predictions read the model several times."""
        if not self.fitted:
            self.grid, self.cdfs = cut(self.grid), cut(self.cdfs)
            self.global_cdf = None if self.global_cdf is None else cut(self.global_cdf)
            self.fitted = True
        return self

    def __repr__(self) -> str:
        m = self.meta
        order = "total" if m.total else f"partial {m.groups or 'comp'}"
        return f"IDRModel(x={m.x}, by={m.by}, order={order}, {'increasing' if m.increasing else 'decreasing'}, y_order={m.y_order}, subsamples={m.subsamples})"

    def __str__(self) -> str:
        m = self.meta
        lines = [
            "Isotonic distributional regression",
            f"  covariates: {', '.join(m.x)}" + (f" (keys: {', '.join(m.by)})" if m.by else ""),
            f"  order: {'total' if m.total else 'partial'}, {'increasing' if m.increasing else 'decreasing'}, {'stochastic dominance' if m.y_order == 'sd' else 'hazard rate'}",
        ]
        lines += [f"  group {kind}: {', '.join(names)}" for kind, names in m.groups]
        return "\n".join(lines + ([f"  averaged over {m.subsamples} subsamples"] if m.subsamples > 1 else []))

    def summary(self) -> DataFrame:
        """by..., n_covariates, n_thresholds, precision, convergence_fraction, and the largest last value (below 1: a sub-CDF)."""
        m = self.meta
        sizes = self.cdfs.groupBy(*m.by).agg(F.count_distinct("at").alias("n_covariates"), F.max(F.try_element_at("cdf", F.lit(-1))).alias("largest_last"))
        grids = self.grid.select(*m.by, F.size("thresholds").alias("n_thresholds"))
        joined = sizes.join(grids, m.by).join(self.diagnostic(), m.by) if m.by else sizes.crossJoin(grids).crossJoin(self.diagnostic())  # one row each
        return joined.select(*m.by, "n_covariates", "n_thresholds", "precision", "convergence_fraction", "largest_last")

    # ---- accessors ----

    def dimension(self) -> int:
        return len(self.meta.x)

    def covariates(self) -> DataFrame:
        return self.cdfs.select(*self.meta.by, "at").distinct()

    def thresholds(self) -> DataFrame:
        return self.grid

    def long(self) -> DataFrame:
        """by..., subsample_id, covariates, threshold, cdf: a row a cell."""
        joined = self._with_grid(self.cdfs)
        cells = joined.select(*self.meta.by, "subsample_id", "at", F.explode(F.arrays_zip(F.col("thresholds").alias("z"), F.col("cdf").alias("c"))).alias("s"))
        return cells.select(*self.meta.by, "subsample_id", *self._named(), F.col("s.z").alias("threshold"), F.col("s.c").alias("cdf"))

    def _named(self) -> list[Column]:
        # group orders change what is compared, so only the untransformed case has the columns' names
        names = self.meta.x if not self.meta.groups else [f"at{i}" for i in range(len(self.meta.x))]
        return [F.col("at")[i].alias(n) for i, n in enumerate(names)]

    def diagnostic(self) -> DataFrame:
        """by..., largest downward step along thresholds (precision); exact fits have none; convergence_fraction 1."""
        steps = C.steps(F.col("cdf"))
        return self.cdfs.groupBy(*self.meta.by).agg(F.max(F.greatest(F.lit(0.0), -F.array_min(steps))).alias("precision"), F.lit(1.0).alias("convergence_fraction"))

    def consistent(self) -> DataFrame:
        """by..., bad: rows whose CDF leaves [0, 1], falls, or misses its grid's length."""
        rising = F.forall(C.steps(F.col("cdf")), lambda s: s >= -1e-9)
        inside = F.forall(F.col("cdf"), lambda c: (c >= 0) & (c <= 1))
        return self._with_grid(self.cdfs).groupBy(*self.meta.by).agg(F.count_if(~(rising & inside & (F.size("cdf") == F.size("thresholds")))).alias("bad"))

    def _with_grid(self, df: DataFrame) -> DataFrame:
        return df.join(self.grid, self.meta.by) if self.meta.by else df.crossJoin(self.grid)  # one row

    # ---- persistence ----

    def save(self, path: str) -> None:
        self.settle()
        self.cdfs.write.parquet(f"{path}/cdfs")
        self.grid.write.parquet(f"{path}/grid")
        if self.global_cdf is not None:
            self.global_cdf.write.parquet(f"{path}/global")
        self.cdfs.sparkSession.createDataFrame([(json.dumps(asdict(self.meta)), self.global_cdf is not None)], "meta string, has_global boolean").coalesce(1).write.json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IDRModel:
        row = spark.read.schema("meta string, has_global boolean").json(f"{path}/meta").first()
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("cdfs"), read("grid"), Meta(**json.loads(row["meta"])), read("global") if row["has_global"] else None)

    @classmethod
    def from_cdfs(cls, spark: SparkSession, cdfs, x, y, names: list[str] | None = None, global_cdf=None) -> IDRModel:
        """A model from a matrix (covariates by thresholds); x and y must strictly ascend (x by rows)."""
        x = np.atleast_2d(np.asarray(x, float).T).T
        y, cdfs = np.asarray(y, float), np.asarray(cdfs, float)
        if cdfs.shape != (len(x), len(y)):
            raise ShapeMismatch(f"{cdfs.shape} values for {len(x)} covariates and {len(y)} thresholds")
        rows = [tuple(r) for r in x.tolist()]
        if any(a >= b for a, b in zip(rows, rows[1:])) or (np.diff(y) <= 0).any():
            raise OrderMismatch("covariates and thresholds must ascend strictly")
        total = x.shape[1] == 1
        names = names or [f"x{i}" for i in range(x.shape[1])]
        frame = spark.createDataFrame([(0, r, c) for r, c in zip(x.tolist(), cdfs.tolist())], "subsample_id int, at array<double>, cdf array<double>")
        grid = spark.createDataFrame([(y.tolist(),)], "thresholds array<double>")
        default = cdfs.mean(0).tolist() if global_cdf is None else list(map(float, global_cdf))
        return cls(frame, grid, Meta(names, total=total), None if total else spark.createDataFrame([(default,)], "cdf array<double>"))

    # ---- prediction ----

    def predict_cdf(self, queries: DataFrame | None = None) -> DataFrame:
        """`queries` (columns of x and by) with `thresholds` and `cdf`; without queries, the model's own covariates.

        Total order: exact row, linear blend between neighbours, end rows
        outside.  Partial order: midpoint of the tightest bounds, one bound, or
        the global CDF.  A null covariate gives a null CDF.  With subsamples the
        CDFs are averaged.
        """
        m = self.settle().meta
        if queries is None:
            queries = self.covariates().select(*m.by, *self._named())
        missing = [c for c in [*m.x, *m.by] if c not in queries.columns]
        if missing:
            raise CovariateDimensionMismatch(f"queries lack {missing}")
        rest = [c for c in queries.columns if c not in ("cdf", "thresholds")]
        queries = queries.select(*[F.col(f"`{c}`") for c in rest])
        found = self._total(queries) if m.total else self._partial(queries)
        return self._with_grid(found).select(*[F.col(f"`{c}`") for c in rest], "thresholds", "cdf")

    def _distinct_queries(self, queries: DataFrame) -> DataFrame:
        """Each distinct covariate is looked up once."""
        return queries.select(*self.meta.by, *[F.col(f"`{c}`").cast("double").alias(f"__q{i}") for i, c in enumerate(self.meta.x)]).distinct()

    def _back(self, queries: DataFrame, found: DataFrame) -> DataFrame:
        keys = [f"__q{i}" for i in range(len(self.meta.x))]
        named = queries.withColumns({k: F.col(f"`{c}`").cast("double") for k, c in zip(keys, self.meta.x)})
        return named.join(found, [*self.meta.by, *keys], "left").drop(*keys)

    def _total(self, queries: DataFrame) -> DataFrame:
        by = [*self.meta.by, "subsample_id"]
        model = self.cdfs.select(*by, F.col("at")[0].alias("q"), "cdf")
        distinct = self._distinct_queries(queries).where(F.col("__q0").isNotNull())
        asked = distinct.select(*self.meta.by, F.col("__q0").alias("q")).withColumn("subsample_id", F.explode(F.sequence(F.lit(0), F.lit(self.meta.subsamples - 1))))
        near = asof_both(asked, model, "q", by)
        left, right = F.coalesce("below", "above"), F.coalesce("above", "below")
        spots = near.select(*by, "q", left.alias("l"), right.alias("r")).where("l is not null")
        share = F.when(F.col("l") == F.col("r"), 0.0).otherwise((F.col("q") - F.col("l")) / (F.col("r") - F.col("l")))
        a = model.select(*by, F.col("q").alias("l"), F.col("cdf").alias("cl"))
        b = model.select(*by, F.col("q").alias("r"), F.col("cdf").alias("cr"))
        mixed = spots.join(a, [*by, "l"]).join(b, [*by, "r"]).select(*by, F.col("q").alias("__q0"), C.blend(F.col("cl"), F.col("cr"), share).alias("cdf"))
        return self._back(queries, self._averaged(mixed, ["__q0"]))

    def _averaged(self, found: DataFrame, keys: list[str]) -> DataFrame:
        if self.meta.subsamples == 1:
            return found.drop("subsample_id")
        group = [*self.meta.by, *keys]
        cells = found.select(*group, F.posexplode("cdf").alias("k", "c")).groupBy(*group, "k").agg(F.avg("c").alias("c"))
        return cells.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("cdf"))

    def _partial(self, queries: DataFrame) -> DataFrame:
        m = self.meta
        keys = [f"__q{i}" for i in range(len(m.x))]
        distinct = self._distinct_queries(queries)
        order = CovariateOrder.parse(m.groups, m.x)
        asked = distinct.withColumn("__at", order.transformed({c: F.col(k) for c, k in zip(m.x, keys)}))
        model = self.cdfs.select(*m.by, "subsample_id", "at", "cdf")
        le = F.forall(F.zip_with("at", "__at", lambda a, b: a <= b), lambda t: t)
        ge = F.forall(F.zip_with("at", "__at", lambda a, b: a >= b), lambda t: t)
        pairs = asked.join(model, m.by) if m.by else asked.crossJoin(model)
        pairs = pairs.where(le | ge).withColumn("__le", le if m.increasing else ge).withColumn("__ge", ge if m.increasing else le)
        cells = pairs.select(*m.by, *keys, "subsample_id", "__le", "__ge", F.posexplode("cdf").alias("k", "c"))
        bounds = cells.groupBy(*m.by, *keys, "subsample_id", "k").agg(F.min(F.when(F.col("__le"), F.col("c"))).alias("hi"), F.max(F.when(F.col("__ge"), F.col("c"))).alias("lo"))
        value = F.coalesce((F.col("lo") + F.col("hi")) / 2, "lo", "hi")
        found = bounds.groupBy(*m.by, *keys, "subsample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("c")))), lambda s: s["c"]).alias("cdf"))
        every = asked.select(*m.by, *keys).withColumn("subsample_id", F.explode(F.sequence(F.lit(0), F.lit(m.subsamples - 1))))
        fallback = self.global_cdf.select(*m.by, F.col("cdf").alias("__global"))
        every = every.join(fallback, m.by) if m.by else every.crossJoin(fallback)  # one row
        known = every.join(found, [*m.by, *keys, "subsample_id"], "left")
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        filled = known.select(*m.by, *keys, "subsample_id", F.when(~null, F.coalesce("cdf", "__global")).alias("cdf")).where("cdf is not null")
        return self._back(queries, self._averaged(filled, keys))

    def predict(self, queries: DataFrame | None = None) -> DataFrame:
        """`queries` with the conditional mean `prediction`."""
        return self.predict_cdf(queries).withColumn("prediction", C.mean(F.col("cdf"), F.col("thresholds"))).drop("cdf", "thresholds")

    def cdf_at(self, queries: DataFrame, y: str) -> DataFrame:
        """`queries` with `cdf_at`: F(y | x) row by row."""
        return self.predict_cdf(queries).withColumn("cdf_at", C.cdf_at(F.col("cdf"), F.col("thresholds"), F.col(y))).drop("cdf", "thresholds")

    def cdf_grid(self, queries: DataFrame, ys: list[float]) -> DataFrame:
        """Every query at every y (ascending): columns y and cdf_at."""
        if any(a > b for a, b in zip(ys, ys[1:])):
            raise OrderMismatch("the grid must ascend")
        grid = F.array(*[F.lit(float(y)) for y in ys])
        rows = self.predict_cdf(queries).withColumn("y", F.explode(grid))
        return rows.withColumn("cdf_at", C.cdf_at(F.col("cdf"), F.col("thresholds"), F.col("y"))).drop("cdf", "thresholds")

    def quantile(self, queries: DataFrame, probabilities: list[float], upper: bool = False) -> DataFrame:
        """Every query at every probability: columns p and quantile."""
        if any(not 0 <= p <= 1 for p in probabilities):
            raise ConfigParseError("probabilities lie in [0, 1]")
        rows = self.predict_cdf(queries).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        return rows.withColumn("quantile", C.quantile(F.col("cdf"), F.col("thresholds"), F.col("p"), upper)).drop("cdf", "thresholds")

    def step_function(self, queries: DataFrame) -> DataFrame:
        """`queries` with points and cdf: what a plot of the CDF draws."""
        return self.predict_cdf(queries).withColumnRenamed("thresholds", "points")


# ---- subsamples ----

def subsample_plan(n: int, subsamples: int | None, size: int | float | None, replacement: bool | None) -> tuple[int, int, bool]:
    """(number, rows of each, with replacement) by the parameter rules.

    A float size is a share in (0, 1].  All rows (n, or 1.0) count as no size
    given: then a subsample has n rows without replacement, half of them with.
    Subsamples of all rows without replacement are one fit.
    """
    if subsamples is not None and subsamples < 1:
        raise SubaggingParameterInconsistency("subsamples must be at least 1")
    share = isinstance(size, float)
    if size is not None and not (0 < size <= 1 if share else 1 <= size <= n):
        raise SubaggingParameterInconsistency(f"subsample size {size}: a share in (0, 1] or 1 to {n} rows")
    if size == (1.0 if share else n):
        size, share = None, False
    if subsamples is None:
        if size is not None:
            raise SubaggingParameterInconsistency("subsample_size needs subsamples")
        if replacement:
            raise SubaggingParameterInconsistency("replace needs subsamples and their size")
        return 1, n, False
    replacement = bool(replacement)
    if size is None:
        size, share = (0.5, True) if replacement else (n, False)
    rows = max(1, math.floor(size * n + 0.5)) if share else int(size)
    return (1 if rows == n and not replacement else subsamples), rows, replacement


RUN = 4096  # copies of a row, or draws, that one row is exploded into


def subsampled(rows: DataFrame, n: int, number: int, size: int, replacement: bool, seed: int) -> DataFrame:
    """`rows`, n in all, with subsample_id: `number` samples of exactly `size` rows each; chosen rows carry their weight times how often.

    Draws depend on the seed and on the rows' values only, not on files or
    partitions: equal rows are counted first and numbered among themselves.
    """
    names = rows.columns
    cells = rows.groupBy(*names).agg(F.count("*").alias("__k"))
    if replacement:
        return _drawn_again(cells, names, n, number, size, seed)
    # a row for every copy, in runs, so that a row with many copies is spread over tasks
    runs = cells.withColumn("__r", F.explode(F.expr(f"sequence(0L, (__k - 1) div {RUN})"))).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "__r")
    copies = runs.withColumn("__j", F.explode(F.expr(f"sequence(__r * {RUN}, least((__r + 1) * {RUN}, __k) - 1)")))
    each = copies.withColumn("subsample_id", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    each = each.withColumn("__h", F.xxhash64(F.lit(seed), "subsample_id", *names, "__j")).withColumn("__b", F.shiftrightunsigned("__h", 48))
    # the size-th smallest hash lies in one of 65536 bins: only that bin is sorted
    bins = each.groupBy("subsample_id", "__b").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("subsample_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    cut = bins.withColumn("__u", upto).where((F.col("__u") >= size) & (F.col("__u") - F.col("__c") < size)).select(
        "subsample_id", F.col("__b").alias("__cut"), (size - (F.col("__u") - F.col("__c"))).alias("__left"))
    joined = each.join(F.broadcast(cut), "subsample_id")  # a row a subsample
    kept = ["subsample_id", *names]
    below = joined.where("__b < __cut").select(*kept)
    nth = F.row_number().over(Window.partitionBy("subsample_id").orderBy("__h", *names, "__j"))
    edge = joined.where("__b = __cut").withColumn("__n", nth).where("__n <= __left").select(*kept)
    taken = below.unionAll(edge).groupBy(*kept).agg(F.count("*").alias("__times"))
    return taken.withColumn("w", F.col("w") * F.col("__times")).select(*names, "subsample_id")


def _drawn_again(cells: DataFrame, names: list[str], n: int, number: int, size: int, seed: int) -> DataFrame:
    """Draws with replacement: each is a place in 0..n-1, and takes the cell of equal rows that covers it."""
    spark = cells.sparkSession
    placed = with_offsets(cells, names, "__k", "__at")
    draws = spark.range(number * size).select(
        (F.col("id") / F.lit(size)).cast("long").cast("int").alias("subsample_id"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("double").alias("__at"))
    times = draws.groupBy("subsample_id", "__at").agg(F.count("*").alias("__times"))
    starts = placed.withColumn("__at", F.col("__at").cast("double"))
    found = asof_both(times, starts.select("__at"), "__at").groupBy("subsample_id", F.col("below").alias("__at")).agg(F.sum("__times").alias("__times"))
    return found.join(starts, "__at").withColumn("w", F.col("w") * F.col("__times")).select(*names, "subsample_id")


# ---- fit ----

def parse_settings(settings: dict | None) -> dict:
    """Solver settings, checked.  Fits here are exact, so they change nothing: {"epsilon": e} or {"osqp_settings": {...}}, not both."""
    settings = settings or {}
    unknown = set(settings) - {"epsilon", "osqp_settings"}
    if unknown:
        raise ConfigParseError(f"unknown settings {sorted(unknown)}")
    if len(settings) == 2:
        raise ConfigParseError("epsilon and osqp_settings exclude each other")
    numbers = dict(settings.get("osqp_settings") or {})
    if set(numbers) - {"verbose", "eps_abs", "eps_rel", "max_iter"}:
        raise ConfigParseError(f"unknown osqp_settings {sorted(set(numbers) - {'verbose', 'eps_abs', 'eps_rel', 'max_iter'})}")
    if "epsilon" in settings:
        numbers["epsilon"] = settings["epsilon"]
    for name, value in numbers.items():
        if name == "verbose":
            if not isinstance(value, bool):
                raise ConfigParseError("verbose is true or false")
        elif isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < math.inf or (name == "max_iter" and value != int(value)):
            raise ConfigParseError(f"{name} must be a positive number")
    return settings


def fit_idr(
    df: DataFrame, y: str, x: str | list[str], observed: str | None = None, weight: str | None = None, by: list[str] | None = None,
    increasing: bool = True, y_order: str = "sd", order=None, grid: list[float] | None = None,
    subsamples: int | None = None, subsample_size: int | float | None = None, replace: bool | None = None, seed: int = 0, method: str = "auto",
    settings: dict | None = None,
) -> IDRModel:
    """Fit the conditional distributions of y given x, ordered in x.

    increasing: larger x, stochastically larger y.  y_order: "sd" or "hazard".
    order: for several covariates, groups of CovariateOrder.  grid: thresholds
    to fit instead of all distinct responses.  by: keys of independent fits.
    method: "sql", "kernel" or "auto".  settings: see parse_settings.  One job
    checks the input and sizes the fit; the fit itself is a plan until a model is
    saved or predicts.  See the README
    for what each fit costs.
    """
    names = [x] if isinstance(x, str) else list(x)
    y_order = y_order.lower()
    if y_order not in Y_ORDERS:
        raise ConfigParseError(f"y_order {y_order!r} is none of {Y_ORDERS}")
    parse_settings(settings)
    by = by or []
    roles = Roles(y, names, observed, weight, by)
    rows = plain(df, roles)
    # upper bounds of what one key holds; they choose the plan and the number of blocks, so estimates do
    seen = validate(rows, len(names), longest=F.approx_count_distinct("x0"), most=F.approx_count_distinct("y"))
    longest, most = seen["longest"], seen["most"] if grid is None else len(set(grid))
    parsed = CovariateOrder.parse(order, names)
    total = len(names) == 1
    censored = seen["censored"] > 0
    if not total:
        poset.check_combination(y_order == "hazard", censored)
    number, size, replacement = subsample_plan(seen["n"], subsamples, subsample_size, replace)
    at = F.array("x0") if total else parsed.transformed({c: F.col(f"x{i}") for i, c in enumerate(names)})
    rows = rows.select(*by, at.alias("at"), "y", "observed", "w")
    full = aggregated(rows, by, ["at"])
    wanted = thresholds(full, by, grid)
    whole = size == seen["n"] and not replacement
    rows = rows.withColumn("subsample_id", F.lit(0)) if whole else subsampled(rows, seen["n"], number, size, replacement, seed)
    keys = [*by, "subsample_id"]
    obs = aggregated(rows, keys, ["at"])
    if censored and not (total and y_order == "hazard"):
        obs = drop_early_censored(obs, keys)
    meta = Meta(names, by, total, increasing, y_order, [[k, list(c)] for k, c in parsed.groups], number)
    if total:
        cdfs = _fit_chain(obs, wanted, keys, by, increasing, y_order, censored, grid, method, longest, most)
    else:
        cdfs = _fit_poset(obs, wanted, keys, by, increasing, y_order, censored)
    return IDRModel(cdfs, wanted, meta, None if total else _global(full, wanted, by, censored), fitted=False)


def _global(obs: DataFrame, wanted: DataFrame, by: list[str], censored: bool) -> DataFrame:
    """by..., cdf: without regard to covariates: Kaplan-Meier or empirical."""
    pooled = obs.groupBy(*by, "y", "observed").agg(F.sum("w").alias("w"))

    def solve(z: np.ndarray, pdf: pd.DataFrame):
        t, s = survival.km_curve(pdf["y"].to_numpy(), pdf["observed"].to_numpy(bool), pdf["w"].to_numpy())
        return [[]], np.append(0.0, 1 - s)[np.searchsorted(t, z, "right")][:, None]

    return _apply(pooled, wanted, by, solve).drop("at", "block")


#: Takes the thresholds of a block and the rows of a group; returns covariates and a matrix (threshold x covariate).
Kernel = Callable[[np.ndarray, pd.DataFrame], tuple[list, np.ndarray]]


def _apply(rows: DataFrame, wanted: DataFrame, keys: list[str], solve: Kernel, blocks: int = 1) -> DataFrame:
    """keys, block, at, cdf: a kernel over the rows of each group, once for each block of consecutive thresholds.

    A block's slice of the thresholds comes as one row beside the group's rows.
    """
    by = [c for c in keys if c != "subsample_id"]
    part = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    size = F.ceil(F.size("thresholds") / blocks).cast("int")
    groups = rows.select(*keys).distinct() if keys else None
    heads = wanted if groups is None else groups.join(wanted, by) if by else groups.crossJoin(wanted)  # without keys, one row
    heads = part(heads).select(*keys, "block", F.slice("thresholds", F.col("block") * F.greatest(size, F.lit(1)) + 1, F.greatest(size, F.lit(1))).alias("__z"))
    return _grouped(part(rows).unionByName(heads, allowMissingColumns=True), [*keys, "block"], solve)


def _grouped(rows: DataFrame, head: list[str], solve: Kernel) -> DataFrame:
    """head, at, cdf by groups of rows of which one has the thresholds __z."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*head).dtypes], "at array<double>", "cdf array<double>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["__z"].notna().to_numpy()
        z = np.asarray(pdf["__z"].to_numpy()[first][0], float) if first.any() else np.zeros(0)
        own = pdf[~first]
        ats, cdf = solve(z, own) if len(own) else ([], np.zeros((len(z), 0)))
        out = pd.DataFrame({"at": ats, "cdf": [c.tolist() for c in np.asarray(cdf).reshape(-1, len(ats)).T] if len(ats) else []})
        for c in head:
            out[c] = pdf[c].iloc[0]
        return out[[*head, "at", "cdf"]]

    return rows.groupBy(*head).applyInPandas(run, schema)


def _joined_blocks(solved: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    if blocks == 1:
        return solved.drop("block")
    return solved.groupBy(*keys, "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "cdf"))), lambda s: s["cdf"])).alias("cdf"))


def _with_thresholds(df: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    return df.join(wanted, by) if by else df.crossJoin(wanted)  # one row


SURVIVAL_BLOCKS = 16


def _fit_chain(obs, wanted, keys, by, increasing, y_order, censored, grid, method, longest, most) -> DataFrame:
    obs = obs.withColumn("x", F.col("at")[0])
    if y_order == "sd" and not censored:
        if method == "sql" or (method == "auto" and longest <= SQL_COVARIATES and most * longest * longest <= 50_000_000):
            cells = sqlform.idr_chain(obs, keys, increasing, grid)
            if len(keys) > len(by) and grid is None:
                # a subsample's own responses are fewer than the grid's: look each grid value up
                full = _with_thresholds(cells.groupBy(*keys, "x").agg(F.array_sort(F.collect_list(F.struct("threshold", "cdf"))).alias("c")), wanted, by)
                t, c = F.transform("c", lambda s: s["threshold"]), F.transform("c", lambda s: s["cdf"])
                same = F.size("c") == F.size("thresholds")
                looked = F.transform("thresholds", lambda z: F.coalesce(F.get(c, F.size(F.filter(t, lambda v: v <= z)) - 1), F.lit(0.0)))
                return full.select(*keys, F.array("x").alias("at"), F.when(same, c).otherwise(looked).alias("cdf"))
            return cells.groupBy(*keys, "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("threshold", "cdf"))), lambda s: s["cdf"]).alias("cdf")).select(*keys, F.array("x").alias("at"), "cdf")
        return _fit_blocks(obs, wanted, keys, by, increasing, longest, most)
    rows = obs.select(*keys, "x", "y", "observed", "w")
    if y_order == "hazard":  # sequential in thresholds
        return _apply(rows, wanted, keys, lambda z, pdf: _survival_kernel(z, pdf, increasing, "hazard_censored" if censored else "hazard")).drop("block")
    # thresholds of S-IDR are independent: blocks of them, each with all of the aggregated rows
    blocks = min(SURVIVAL_BLOCKS, max(1, most))
    return _joined_blocks(_apply(rows, wanted, keys, lambda z, pdf: _survival_kernel(z, pdf, increasing, "sidr"), blocks), keys, blocks)


def _fit_blocks(obs, wanted, keys, by, increasing, longest, most) -> DataFrame:
    """Uncensored chains in blocks of consecutive thresholds.

    A block gets the covariates with their weights and what lies below it (sums
    by covariate and block, added up by a window), its own rows, and its
    thresholds once.  Rows find their block among the blocks' last thresholds.
    """
    blocks = max(1, -(-most * max(longest, 1) // BLOCK_CELLS))
    size = F.greatest(F.ceil(F.size("thresholds") / blocks).cast("int"), F.lit(1))
    lasts = wanted.select(*by, F.transform(F.sequence(F.lit(1), F.lit(blocks)), lambda b: F.get("thresholds", F.least(b * size, F.size("thresholds")) - 1)).alias("__lasts"))
    rows = _with_thresholds(obs, lasts, by)  # as many numbers as blocks
    rows = rows.withColumn("block", F.size(F.filter("__lasts", lambda z: z < F.col("y")))).drop("__lasts")
    sums = rows.groupBy(*keys, "x", "block").agg(F.sum("w").alias("m"))
    every = sums.groupBy(*keys, "x").agg(F.sum("m").alias("total")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    below = Window.partitionBy(*keys, "x").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(sums, [*keys, "x", "block"], "left").select(
        *keys, "block", "x", F.lit(None).cast("double").alias("y"), F.coalesce(F.sum(F.coalesce("m", F.lit(0.0))).over(below), F.lit(0.0)).alias("w"), "total")
    own = rows.where(F.col("block") < blocks).select(*keys, "block", "x", "y", "w", F.lit(None).cast("double").alias("total"))
    groups = every.select(*keys, "block").distinct()
    heads = (groups.join(wanted, by) if by else groups.crossJoin(wanted)).select(*keys, "block", F.slice("thresholds", F.col("block") * size + 1, size).alias("__z"))

    def solve(z: np.ndarray, pdf: pd.DataFrame):
        base = pdf[pdf["y"].isna()].sort_values("x")
        mine = pdf[pdf["y"].notna()]
        xs = base["x"].to_numpy()
        counts = np.zeros((len(z) + 1, len(xs)))
        np.add.at(counts, (np.searchsorted(z, mine["y"].to_numpy()), np.searchsorted(xs, mine["x"].to_numpy())), mine["w"].to_numpy())
        counts = np.cumsum(counts[:-1], 0) + base["w"].to_numpy()
        return [[v] for v in xs.tolist()], np.clip(chain_fits(counts, base["total"].to_numpy(), not increasing), 0, 1)

    return _joined_blocks(_grouped(carried.unionByName(own).unionByName(heads, allowMissingColumns=True), [*keys, "block"], solve), keys, blocks)


def _survival_kernel(z: np.ndarray, pdf: pd.DataFrame, increasing: bool, kind: str):
    sign = 1.0 if increasing else -1.0
    xs, xi = np.unique(sign * pdf["x"].to_numpy(), return_inverse=True)
    ts, ti = np.unique(pdf["y"].to_numpy(), return_inverse=True)
    w, seen = pdf["w"].to_numpy(), pdf["observed"].to_numpy(bool)
    events, leaves = np.zeros((len(ts), len(xs))), np.zeros((len(ts), len(xs)))
    np.add.at(events, (ti[seen], xi[seen]), w[seen])
    np.add.at(leaves, (ti[~seen], xi[~seen]), w[~seen])
    times = ts[events.any(1)]
    ats = [[sign * v] for v in xs.tolist()]
    if kind == "sidr":
        at = np.searchsorted(times, z, "right") - 1
        known = at[at >= 0]
        if not len(known):
            return ats, np.zeros((len(z), len(xs)))
        first, last = int(known.min()), int(known.max()) + 1
        cdf = survival.sidr(events, leaves, first=first, last=last)
        cdf = np.vstack((np.zeros((1, len(xs))), cdf))
        return ats, cdf[np.where(at < 0, 0, at - first + 1)]
    if kind == "hazard":
        cdf = survival.hazard_uncensored(np.cumsum(events[events.any(1)], 0), events.sum(0))
    else:
        cdf = survival.hazard_censored(events, leaves)
    cdf = np.clip(np.vstack((np.zeros((1, len(xs))), cdf)), 0, 1)
    return ats, cdf[np.searchsorted(times, z, "right")]


def _fit_poset(obs, wanted, keys, by, increasing, y_order, censored) -> DataFrame:
    sequential = y_order == "hazard"

    def solve(z: np.ndarray, pdf: pd.DataFrame):
        at = np.stack(pdf["at"].to_list())
        u, node = np.unique(at, axis=0, return_inverse=True)
        node = node.ravel()
        before = poset.dominance(u)
        before = before if increasing else before.T
        y, w, seen = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["observed"].to_numpy(bool)
        if censored:
            return u.tolist(), poset.partial_sidr(node, y, seen, w, before, z)
        weights = np.bincount(node, w, len(u))
        cells = np.zeros((len(z) + 1, len(u)))
        np.add.at(cells, (np.searchsorted(z, y), node), w)
        counts = np.cumsum(cells[:-1], 0)
        cdf = poset.partial_idr(counts, weights, before, sequential) if len(z) else np.zeros((0, len(u)))
        return u.tolist(), cdf

    blocks = 1 if sequential else SURVIVAL_BLOCKS
    return _joined_blocks(_apply(obs.select(*keys, "at", "y", "observed", "w"), wanted, keys, solve, blocks), keys, blocks)
