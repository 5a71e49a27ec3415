"""Column roles, validation, and the aggregated tables that every fit starts from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigParseError, CovariateOrderInconsistency, EmptyInput, IncompatibleShapes, NegativeWeights, NonFiniteFloats


@dataclass(frozen=True)
class Roles:
    """Which columns are what.  x: covariates; by: keys of independent fits."""

    y: str
    x: list[str]
    observed: str | None = None
    weight: str | None = None
    by: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for c in self.x:
            if c in self.by:
                raise CovariateOrderInconsistency(f"{c} is both a covariate and a key")


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def plain(df: DataFrame, roles: Roles) -> DataFrame:
    """by..., x0.., y, observed, w as doubles and a boolean; a missing observed is true, a missing weight 1."""
    missing = [c for c in [roles.y, *roles.x, roles.observed, roles.weight, *roles.by] if c and c not in df.columns]
    if missing:
        raise IncompatibleShapes(f"no such columns: {missing}")
    # + 0.0 turns -0.0 into 0.0, so that sorting and grouping agree
    number = lambda c: F.col(f"`{c}`").cast("double") + F.lit(0.0)
    return df.select(
        *[F.col(f"`{c}`") for c in roles.by],
        *[number(c).alias(f"x{i}") for i, c in enumerate(roles.x)],
        number(roles.y).alias("y"),
        (F.col(f"`{roles.observed}`").cast("boolean") if roles.observed else F.lit(True)).alias("observed"),
        (number(roles.weight) if roles.weight else F.lit(1.0)).alias("w"),
    )


def validate(rows: DataFrame, covariates: int, **more: Column) -> dict:
    """One aggregate over the input; raises in the order covariates, emptiness, responses, weights.

    Returns n, censored (rows that are not observed) and the aggregates `more`.
    """
    bad_x = F.lit(False)
    for i in range(covariates):
        bad_x = bad_x | not_finite(F.col(f"x{i}"))
    found = rows.agg(
        F.count("*").alias("n"), F.count_if(bad_x).alias("x"),
        F.count_if(not_finite(F.col("y")) | not_finite(F.col("w")) | F.col("observed").isNull()).alias("y"),
        F.count_if(F.col("w") < 0).alias("w"), F.count_if(~F.col("observed")).alias("censored"),
        *[c.alias(name) for name, c in more.items()]).first()
    if found["x"]:
        raise NonFiniteFloats(f"{found['x']} rows with a null, NaN or infinite covariate")
    if not found["n"]:
        raise EmptyInput("no rows")
    if found["y"]:
        raise NonFiniteFloats(f"{found['y']} rows with a null, NaN or infinite response, indicator or weight")
    if found["w"]:
        raise NegativeWeights(f"{found['w']} rows with a negative weight")
    return found.asDict()


def aggregated(rows: DataFrame, by: list[str], x: list[str]) -> DataFrame:
    """by..., x..., y, observed, w: equal rows added up; rows of weight zero go."""
    return rows.groupBy(*by, *x, "y", "observed").agg(F.sum("w").alias("w")).where("w > 0")


def drop_early_censored(obs: DataFrame, by: list[str]) -> DataFrame:
    """Without the censored rows before the first event of their fit."""
    first = obs.where("observed").groupBy(*by).agg(F.min("y").alias("__first"))
    joined = obs.join(first, by, "left") if by else obs.crossJoin(first)  # one row
    return joined.where(F.col("observed") | (F.col("y") >= F.col("__first"))).drop("__first")


def thresholds(obs: DataFrame, by: list[str], grid: list[float] | None = None) -> DataFrame:
    """by..., thresholds: the sorted distinct event responses, or the given grid."""
    if grid is not None:
        values = F.array(*[F.lit(float(z)) for z in sorted(set(grid))])
        return (obs.select(*by).distinct() if by else obs.sparkSession.range(1).select()).select(*by, values.alias("thresholds"))
    return obs.groupBy(*by).agg(F.sort_array(F.collect_set(F.when(F.col("observed"), F.col("y")))).alias("thresholds"))


def ecdf(df: DataFrame, y: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., value, cdf: share of weight at or below each distinct response."""
    from pyspark.sql import Window

    by = by or []
    mass = df.groupBy(*by, F.col(y).alias("value")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("m"))
    part = Window.partitionBy(*by)
    return mass.select(*by, "value", F.least(F.sum("m").over(part.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("m").over(part), F.lit(1.0)).alias("cdf"))


# ---- order of several covariates ----

KINDS = ("comp", "sd", "icx")


def _running_sums(values: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.slice(values, 1, i), F.lit(0.0), lambda a, b: a + b))


@dataclass(frozen=True)
class CovariateOrder:
    """groups: (kind, column names); columns in no group are compared as they are.

    comp: componentwise.  sd: as exchangeable values, sorted from the largest.
    icx: sorted from the largest and added up.
    """

    groups: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def parse(cls, groups, columns: list[str]) -> CovariateOrder:
        out, seen = [], set()
        for kind, names in groups or ():
            kind = str(kind).lower()
            if kind not in KINDS:
                raise ConfigParseError(f"order {kind!r} is none of {KINDS}")
            for c in names:
                if c in seen or c not in columns:
                    raise CovariateOrderInconsistency(f"{c} is named twice or not a covariate")
                seen.add(c)
            if len(names) > 1 or kind == "comp":  # alone, a column is compared as it is
                out.append((kind, tuple(names)))
        return cls(tuple(out))

    def transformed(self, columns: dict[str, Column]) -> Column:
        """array<double> that is compared componentwise: the groups in order, then the rest."""
        parts, used = [], set()
        for kind, names in self.groups:
            used |= set(names)
            values = F.array(*[columns[c] for c in names])
            if kind != "comp":
                values = F.sort_array(values, asc=False)
            if kind == "icx":
                values = _running_sums(values, len(names))
            parts.append(values)
        rest = [columns[c] for c in columns if c not in used]
        if rest:
            parts.append(F.array(*rest))
        return F.concat(*parts)
