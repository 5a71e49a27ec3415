"""A static model over streams, and sums that a refit can start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TooLarge
from ..functions import cdf as C
from ..model import IDRModel


#: Cells (covariates times thresholds) of a model that goes along with every task of a stream: 32 MB.
STREAM_CELLS = 4_000_000


def score_batches(model: IDRModel, y: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch with `cdf_at`, by the model's own joins, given to `write`.  For models of any size, order and keys."""
    return lambda batch, number: write(model.cdf_at(batch, y), number)


def score_stream(stream: DataFrame, model: IDRModel, x: str, y: str) -> DataFrame:
    """A stream with `cdf_at` of a total-order model without keys: a stream-static lookup, no state.

    The model's rows, one a covariate, go along as one array, so its size is
    checked: beyond STREAM_CELLS cells use `score_batches`.
    """
    cells = model.cdfs.agg(F.coalesce(F.sum(F.size("cdf").cast("long")), F.lit(0))).first()[0]
    if cells > STREAM_CELLS:
        raise TooLarge(f"a model of {cells} cells doesn't go along with a stream ({STREAM_CELLS} at most): use score_batches")
    m = model.cdfs.select(F.struct(F.col("at")[0].alias("x"), "cdf").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    static = m.crossJoin(model.grid)
    joined = stream.crossJoin(F.broadcast(static))
    q = F.col(x).cast("double")
    n = F.size("rows")
    below = F.size(F.filter("rows", lambda r: r["x"] <= q))
    left = lambda k: F.get(F.col("rows"), F.greatest(k - 1, F.lit(0)))
    right = lambda k: F.get(F.col("rows"), F.least(F.when(left(k)["x"] == q, k - 1).otherwise(k), n - 1))

    def value(k: Column) -> Column:
        a, b = left(k), right(k)
        share = F.when((k == 0) | (a["x"] == b["x"]), 0.0).otherwise((q - a["x"]) / (b["x"] - a["x"]))
        at = lambda r: C.cdf_at(r["cdf"], F.col("thresholds"), F.col(y).cast("double"))
        return (1 - share) * at(a) + share * at(b)

    return joined.select(*[F.col(f"`{c}`") for c in stream.columns], C.let(below, value).alias("cdf_at"))


def sums_stream(stream: DataFrame, x: str, y: str, observed: str | None = None, weight: str | None = None) -> DataFrame:
    """x, y, observed, w summed up over a stream (complete or update mode): all that a refit needs."""
    seen = F.col(observed).cast("boolean") if observed else F.lit(True)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return stream.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), seen.alias("observed")).agg(F.sum(w).alias("w"))


def late_sums_stream(stream: DataFrame, time: str, x: str, y: str, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """The same by event-time window, with a watermark: late rows count until `delay`."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("w"))
