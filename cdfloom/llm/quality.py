"""Quality rules as robust multivariate outliers (DataFrame functions only).

Every text gives a few counts; simple base rules reject the obviously broken
ones.  The rest are judged by the minimum-covariance-determinant (MCD) method:
per language and source the centre and covariance of the transformed
statistics are estimated on the most concentrated share `h` of the rows, by
repeated concentration steps, and rows beyond a Mahalanobis cutoff go.

Everything that is summed is a fixed-point integer and every rank is taken over
integer bins, so the estimates do not depend on the order of rows or tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, materialize, replaced, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 4
SCALE = 1000  # fixed-point units per 1.0 of a transformed statistic
BINS = 32  # distance bins per unit of ln(d2)


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: the base rules.

    h: share of rows that the MCD concentrates on.  steps: concentration steps.
    prior_rows: weight, in rows, of the language's estimate in a source's.
    floors: least standard deviation of each statistic (a statistic that most
    rows share exactly would otherwise make the covariance singular).
    tail: chi-square tail probability of the cutoff.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    h: float = 0.6
    steps: int = 3
    prior_rows: int = 25
    floors: tuple[float, ...] = (0.05, 0.03, 0.2, 0.15)
    tail: float = 1e-5


def text_counts(text: Column) -> Column:
    """Struct of COUNTS and n_lines (lines with a word), all long; zeros for null."""
    text = F.coalesce(text, F.lit(""))

    def repeated(words: Column) -> Column:
        def grams(hashes: Column) -> Column:
            n = F.size(hashes)
            two = F.zip_with(hashes, F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))
            three = F.zip_with(two, F.slice(hashes, 3, n), lambda a, b: F.xxhash64(a, b))
            return F.slice(three, 1, n - 2)

        def covered(keys: Column) -> Column:
            """Words in the windows whose key occurs again: window starts, then the gaps between them."""
            pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

            def starts(p: Column) -> Column:
                n = F.size(p)
                twin = F.zip_with(p, F.slice(p, 2, n), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))
                return let(twin, lambda t: F.array_sort(F.transform(
                    F.filter(F.zip_with(p, F.zip_with(t, F.concat(F.array(F.lit(False)), t), lambda x, y: x | F.coalesce(y, F.lit(False))),
                                        lambda a, d: F.when(d & a.isNotNull(), a["i"])), lambda x: x.isNotNull()), lambda x: x)))

            return let(let(pairs, starts), lambda s: F.aggregate(
                F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
                F.lit(0).cast("long"), lambda acc, x: acc + x))

        return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
            let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), lambda k: F.when(
                F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k))))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(words_of(text), lambda w: let(lines, lambda ls: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated(w).alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
    )))


def transformed(c) -> list[Column]:
    """The statistic vector in fixed-point units, from a function that names a count's column."""
    share = lambda a, b: F.sqrt(c(a) / F.greatest(c(b), F.lit(1)))
    raw = [
        F.log((c("word_chars") + 1) / (c("n_words") + 1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _chi2_cdf(x: float, even_dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even_dof // 2))


def chi2_quantile(p: float, even_dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, even_dof) < p else (lo, mid)
    return hi


def _distance2(x: list[Column], prefix: str) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor `prefix`l_ij."""

    def solve(i: int, y: list[Column]) -> Column:
        if i == DIMS:
            return sum((v * v for v in y[1:]), y[0] * y[0])
        rest = x[i] - F.col(f"{prefix}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}l{i}{j}") * y[j]
        return let(rest / F.col(f"{prefix}l{i}{i}"), lambda v: solve(i + 1, [*y, v]))

    return solve(0, [])


def _factored(est: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the Cholesky factor of the covariance s_ij."""
    for j in range(DIMS):
        for i in range(j, DIMS):
            v = F.col(f"s{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floors were added to the diagonal, so pivots stay positive; 1 unit guards rounding
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1.0))) if i == j else v / F.col(f"l{j}{j}"))
    return est.select(*keys, "n", *[f"m{i}" for i in range(DIMS)], *[f"s{i}{j}" for i in range(DIMS) for j in range(i + 1)],
                      *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of `a` stay."""
    b = b.select(*[F.col(k).alias(f"__b_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys]
    return a.join(b, cond, how).drop(*[f"__b_{k}" for k in keys])


def mcd_estimates(rows: DataFrame, keys: list[str], rules: QualityRules, prior: DataFrame | None = None, prior_keys: list[str] | None = None) -> DataFrame:
    """MCD centre and covariance (with Cholesky factor) of x0.. per `keys`.

    One row per group.  The start ranks rows by their coordinate-wise distance
    from the group's median in units of max(MAD, floor); each step keeps the
    bins of smallest distance that reach the share h and re-estimates on them.
    A group is summed up by (group, bin) before any shuffle, so a hot group
    never lies in one task.
    """
    floors = [f * SCALE for f in rules.floors]
    q = chi2_quantile(rules.h, DIMS)
    consistency = rules.h / _chi2_cdf(q, DIMS + 2)
    x = [F.col(f"x{i}") for i in range(DIMS)]

    medians = rows.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"c{i}") for i, c in enumerate(x)])
    spreads = _same_keys(rows, medians, keys).groupBy(*keys).agg(
        *[F.first(f"c{i}").alias(f"m{i}") for i in range(DIMS)],
        *[F.percentile(F.abs(c - F.col(f"c{i}")), F.lit(0.5)).alias(f"d{i}") for i, c in enumerate(x)],
    )
    est = spreads.withColumn("n", F.lit(0))
    for i in range(DIMS):
        for j in range(i + 1):
            s = (F.col(f"d{i}") * 1.4826) ** 2 + floors[i] ** 2 if i == j else F.lit(0.0)
            est = est.withColumn(f"s{i}{j}", s)
    est = _factored(est, keys)

    for _ in range(rules.steps):
        binned = _same_keys(rows, est, keys).select(
            *keys, *x, F.floor(F.log(_distance2(x, "") + 0.001) * BINS).cast("int").alias("bin"))
        sums = binned.groupBy(*keys, "bin").agg(
            F.count("*").alias("k"),
            *[F.sum(c).alias(f"t{i}") for i, c in enumerate(x)],
            *[F.sum(x[i] * x[j]).alias(f"u{i}{j}") for i in range(DIMS) for j in range(i + 1)],
        )
        group = Window.partitionBy(*keys)  # a few hundred bins a group
        ranked = sums.withColumn("upto", F.sum("k").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))) \
                     .withColumn("all", F.sum("k").over(group))
        core = ranked.where(F.coalesce(F.col("upto"), F.lit(0)) < F.ceil(F.col("all") * rules.h)).groupBy(*keys).agg(
            F.sum("k").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(DIMS)],
            *[F.sum(f"u{i}{j}").alias(f"u{i}{j}") for i in range(DIMS) for j in range(i + 1)])
        mean = [F.col(f"t{i}") / F.col("n") for i in range(DIMS)]
        est = core.select(
            *keys, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)],
            *[((F.col(f"u{i}{j}") / F.col("n") - mean[i] * mean[j]) * consistency + (floors[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}")
              for i in range(DIMS) for j in range(i + 1)])
        if prior is not None:
            named = [f"m{i}" for i in range(DIMS)] + [f"s{i}{j}" for i in range(DIMS) for j in range(i + 1)]
            p = prior.select(*prior_keys, *[F.col(c).alias(f"p_{c}") for c in named])
            k = F.lit(float(rules.prior_rows))
            est = _same_keys(est, p, prior_keys).select(
                *keys, "n", *[((F.col(c) * F.col("n") + F.col(f"p_{c}") * k) / (F.col("n") + k)).alias(c) for c in named])
        est = _factored(est, keys)
    return est


def score_quality(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (its columns `keep`, default all) with COUNTS, base_failed, distance2 and kept.

    Null and empty texts have zero counts and fail the base rules.  A null
    language or source is a group of its own.  Rows that fail the base rules
    take no part in the estimates.  A language without a row that passes has no
    estimate and needs none.  Input columns named like an output are replaced.
    Repeated rows are judged alike.  An empty table gives an empty result.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]) if (keep is None or keep) else F.struct(F.lit(0).alias("__none"))
    counted = docs.select(
        row.alias("row"), docs[f"`{lang_col}`"].alias("lang"), docs[f"`{source_col}`"].alias("source"),
        text_counts(docs[f"`{text_col}`"]).alias("c"),
    )
    counted = materialize(counted, "quality-counts")
    c = lambda name: F.col(f"c.{name}")
    base_failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"))
    vectors = transformed(c)
    good = counted.where(~base_failed).select("lang", "source", *[v.alias(f"x{i}") for i, v in enumerate(vectors)])
    by_lang = materialize(mcd_estimates(good, ["lang"], rules), "quality-lang")
    by_source = materialize(mcd_estimates(good, ["lang", "source"], rules, by_lang, ["lang"]), "quality-source")

    cutoff = chi2_quantile(1 - rules.tail, DIMS)
    judged = _same_keys(
        counted.select("row", "c", "lang", "source", base_failed.alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(vectors)]),
        by_source, ["lang", "source"], "left")
    d2 = _distance2([F.col(f"x{i}") for i in range(DIMS)], "")
    judged = judged.select(
        "row.*",
        F.struct(*[c(n).alias(n) for n in COUNTS], "base_failed", d2.alias("distance2")).alias("__judged"))
    j = lambda n: F.col(f"__judged.{n}")
    out = {n: j(n) for n in COUNTS} | {
        "base_failed": j("base_failed"), "distance2": j("distance2"),
        "kept": ~j("base_failed") & (F.coalesce(j("distance2"), F.lit(0.0)) <= cutoff)}
    return replaced(judged, out).drop("__judged", "__none")


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs["text"], docs["lang"], docs["source"])
    scored = score_quality(inner, rules, keep=["__row"])
    return scored.where("kept").select("__row.*")
