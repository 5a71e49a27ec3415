"""Distributional index models: a point model, then IDR on its prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import IDRModel, fit_idr


class IndexModel:
    """index: adds a column `index_col` to a table; idr: the model on it."""

    def __init__(self, index: Callable[[DataFrame], DataFrame], index_col: str, idr: IDRModel, training: DataFrame) -> None:
        self.index, self.index_col, self.idr, self._training = index, index_col, idr, training

    def predict_cdf(self, data: DataFrame | None = None) -> DataFrame:
        """Without data, in sample."""
        return self.idr.predict_cdf(self.index(self._training if data is None else data))


def fit_index_model(df: DataFrame, y: str, index, index_col: str = "prediction", **options) -> IndexModel:
    """index: a pyspark.ml estimator or pipeline, or a function from a table to a function that adds `index_col`."""
    if hasattr(index, "fit"):
        fitted = index.fit(df)
        apply = fitted.transform
    else:
        apply = index(df)
    return IndexModel(apply, index_col, fit_idr(apply(df), y, index_col, **options), df)
