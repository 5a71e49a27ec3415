"""Table functions for SQL: `isotonic`, `kaplan_meier` and `idr_cdf` over TABLE(...) [PARTITION BY ...], and the same by
key (`isotonic_by` ...), whose first column is the key.  A partition's rows are gathered, so sum equal ones up first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from ..kernels.pava import chain_fits, pava
from ..kernels.survival import km_curve


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


class _Gather:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row):
        self.rows.append(tuple(row))


class Isotonic(_Gather):
    """TABLE(x, y [, weight]) -> increasing fit at distinct x."""

    def terminate(self):
        a = np.array([(float(r[0]), float(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in self.rows]).reshape(-1, 3)
        u, at = np.unique(a[:, 0], return_inverse=True)
        w = np.bincount(at, a[:, 2], len(u))
        v = np.bincount(at, a[:, 1] * a[:, 2], len(u)) / np.where(w > 0, w, 1)
        for x, f in zip(u.tolist(), pava(v, w).tolist()):
            yield x, f


class KaplanMeier(_Gather):
    """TABLE(time, event [, weight]) -> survival at event times."""

    def terminate(self):
        t, s = km_curve(np.array([float(r[0]) for r in self.rows]), np.array([bool(r[1]) for r in self.rows]), np.array([float(r[2]) if len(r) > 2 else 1.0 for r in self.rows]))
        yield from zip(t.tolist(), s.tolist())


class IdrCdf(_Gather):
    """TABLE(x, y [, weight]) -> the increasing IDR fit."""

    def terminate(self):
        a = np.array([(float(r[0]), float(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in self.rows]).reshape(-1, 3)
        xs, xi = np.unique(a[:, 0], return_inverse=True)
        zs, zi = np.unique(a[:, 1], return_inverse=True)
        counts = np.zeros((len(zs), len(xs)))
        np.add.at(counts, (zi, xi), a[:, 2])
        counts = np.cumsum(counts, 0)
        cdf = chain_fits(counts, counts[-1] if len(counts) else np.zeros(0), False)
        for j, z in enumerate(zs.tolist()):
            for i, x in enumerate(xs.tolist()):
                yield x, z, float(cdf[j, i])


def _keyed(kernel: type, *names: str) -> type:
    """The function by key: TABLE(key, ...) -> key and the function's columns; it asks for rows by key itself."""
    class ByKey:
        def __init__(self, analysed=None) -> None:
            self.inner, self.key = kernel(), None

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            first = table.dataType.fields[0]
            return AnalyzeResult(StructType([StructField("key", first.dataType), *_doubles(*names).fields]), partitionBy=[PartitioningColumn(f"`{first.name}`")])

        def eval(self, row):
            self.key, *rest = row
            self.inner.eval(rest)

        def terminate(self):
            for out in self.inner.terminate():
                yield self.key, *out

    return udtf(ByKey)


def register(spark: SparkSession) -> None:
    spark.udtf.register("isotonic", udtf(Isotonic, returnType=_doubles("x", "fitted")))
    spark.udtf.register("kaplan_meier", udtf(KaplanMeier, returnType=_doubles("time", "survival")))
    spark.udtf.register("idr_cdf", udtf(IdrCdf, returnType=_doubles("x", "threshold", "cdf")))
    spark.udtf.register("isotonic_by", _keyed(Isotonic, "x", "fitted"))
    spark.udtf.register("kaplan_meier_by", _keyed(KaplanMeier, "time", "survival"))
    spark.udtf.register("idr_cdf_by", _keyed(IdrCdf, "x", "threshold", "cdf"))
