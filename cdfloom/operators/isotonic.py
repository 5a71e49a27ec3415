"""Isotonic mean regression over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import poset
from ..kernels.pava import pava
from .prep import CovariateOrder, Roles, plain, validate


def isotonic_mean(df: DataFrame, y: str, x: str | list[str], weight: str | None = None, by: list[str] | None = None, increasing: bool = True, order=None) -> DataFrame:
    """by..., the covariates and `fitted`: one row a distinct covariate.

    Equal covariates are pooled by their weighted mean first, in the shuffle's
    map side.  Several covariates are ordered componentwise, or by `order`
    (see CovariateOrder); they are fitted exactly and take 8192 distinct rows a
    group at most.
    """
    names = [x] if isinstance(x, str) else list(x)
    by = by or []
    roles = Roles(y, names, None, weight, by)
    rows = plain(df, roles)
    validate(rows, len(names))
    xs = [f"x{i}" for i in range(len(names))]
    points = rows.groupBy(*by, *xs).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.avg("y").alias("m"))
    points = points.select(*by, *xs, "w", F.when(F.col("w") > 0, F.col("wy") / F.col("w")).otherwise(F.col("m")).alias("v"))
    parsed = CovariateOrder.parse(order, names)
    points = points.withColumn("at", parsed.transformed({n: F.col(c) for n, c in zip(names, xs)}))
    single = len(names) == 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if single:
            pdf = pdf.sort_values("x0", kind="stable")
            fitted = pava(pdf["v"].to_numpy(), pdf["w"].to_numpy(), increasing)
        else:
            at = np.stack(pdf["at"].to_list())
            u, inverse = np.unique(at, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            w = np.bincount(inverse, pdf["w"].to_numpy(), len(u))
            v = np.bincount(inverse, pdf["w"].to_numpy() * pdf["v"].to_numpy(), len(u)) / np.where(w > 0, w, 1)
            before = poset.dominance(u)
            fitted = poset.isotonic_mean(v, w, before if increasing else before.T)[inverse]
        return pdf[[*by, *xs]].assign(fitted=fitted)

    schema = ", ".join([*[f"`{c}` {t}" for c, t in points.select(*by).dtypes], *[f"{c} double" for c in xs], "fitted double"])
    out = points.groupBy(*by).applyInPandas(fit, schema) if by else points.groupBy(F.lit(0).alias("__g")).applyInPandas(fit, schema)
    return out.select(*by, *[F.col(c).alias(n) for c, n in zip(xs, names)], "fitted")


def isotonic_indexed(df: DataFrame, y: str | list[str], index: str, weight: str | None = None, by: list[str] | None = None, increasing: bool = True) -> DataFrame:
    """by..., index and `fitted` (or `fitted_<name>` for several y): the monotone fit over rows in order of `index`.

    No covariate: every row is an item of its own, rows of one index in any
    order that weight and value give.  Several responses share index and
    weights and are fitted on their own, as stacked rows are.  A group of `by`
    is one chain, so it is one task.
    """
    ys = [y] if isinstance(y, str) else list(y)
    by = by or []
    for name in ys:
        validate(plain(df, Roles(name, [index], None, weight, by)), 1)
    number = lambda c: F.col(f"`{c}`").cast("double") + F.lit(0.0)
    rows = df.select(*[F.col(f"`{c}`") for c in by], F.col(f"`{index}`").alias("__i"), (number(weight) if weight else F.lit(1.0)).alias("__w"), *[number(c).alias(f"__y{k}") for k, c in enumerate(ys)])
    fitted = ["fitted"] if isinstance(y, str) else [f"fitted_{c}" for c in ys]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__i", "__w", *[f"__y{k}" for k in range(len(ys))]], kind="stable")
        out = pdf[[*by, "__i"]].copy()
        for k, name in enumerate(fitted):
            out[name] = pava(pdf[f"__y{k}"].to_numpy(), pdf["__w"].to_numpy(), increasing)
        return out

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by, "__i").dtypes], *[f"`{c}` double" for c in fitted]])
    grouped = rows.groupBy(*by) if by else rows.groupBy(F.lit(0).alias("__g"))
    return grouped.applyInPandas(fit, schema).withColumnRenamed("__i", index)


def isotonic_edges(values: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Isotonic means under explicit constraints.

    values: by..., node, value, optional weight.  edges: by..., lo, hi (node lo
    precedes node hi).  Returns by..., node, fitted.
    """
    by = by or []
    if "weight" not in values.columns:
        values = values.withColumn("weight", F.lit(1.0))

    def fit(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node")
        at = {n: i for i, n in enumerate(v["node"])}
        pairs = np.array([(at[a], at[b]) for a, b in zip(e["lo"], e["hi"]) if a in at and b in at], int).reshape(-1, 2)
        fitted = poset.isotonic_mean(v["value"].to_numpy(float), v["weight"].to_numpy(float), _condensed(len(v), pairs))
        return v[[*by, "node"]].assign(fitted=fitted)

    keyed = [d if by else d.withColumn("__g", F.lit(0)) for d in (values, edges)]
    keys = by or ["__g"]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in values.select(*by, "node").dtypes], "fitted double"])
    return keyed[0].groupBy(*keys).cogroup(keyed[1].groupBy(*keys)).applyInPandas(fit, schema)


def _condensed(n: int, pairs: np.ndarray) -> np.ndarray:
    return poset.closure(n, pairs)
