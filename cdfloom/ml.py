"""pyspark.ml estimator and model: they have Params, enter a Pipeline, and can be saved and loaded."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConfigParseError
from .functions import cdf as C
from .model import IDRModel, fit_idr

#: Options of fit_idr, each a Param of its name.
OPTIONS = ("observed", "weight", "by", "increasing", "y_order", "order", "grid", "subsamples", "subsample_size", "replace", "seed", "method", "settings")


class _IdrParams(Params):
    """labelCol, featureCols and the options of fit_idr."""

    labelCol = Param(Params._dummy(), "labelCol", "response column")
    featureCols = Param(Params._dummy(), "featureCols", "covariate columns")
    observed = Param(Params._dummy(), "observed", "indicator column: whether the response is an event")
    weight = Param(Params._dummy(), "weight", "weight column")
    by = Param(Params._dummy(), "by", "key columns of independent fits")
    increasing = Param(Params._dummy(), "increasing", "whether larger covariates mean larger responses")
    y_order = Param(Params._dummy(), "y_order", "sd or hazard")
    order = Param(Params._dummy(), "order", "groups of covariates: [kind, columns]")
    grid = Param(Params._dummy(), "grid", "thresholds to fit")
    subsamples = Param(Params._dummy(), "subsamples", "number of subsamples")
    subsample_size = Param(Params._dummy(), "subsample_size", "rows or share of a subsample")
    replace = Param(Params._dummy(), "replace", "whether subsamples are drawn with replacement")
    seed = Param(Params._dummy(), "seed", "seed of the draws")
    method = Param(Params._dummy(), "method", "sql, kernel or auto")
    settings = Param(Params._dummy(), "settings", "solver settings, checked only")

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setFeatureCols(self, value: list[str] | str):
        return self._set(featureCols=[value] if isinstance(value, str) else list(value))

    def getLabelCol(self) -> str:
        return self.getOrDefault(self.labelCol)

    def getFeatureCols(self) -> list[str]:
        return self.getOrDefault(self.featureCols)

    def _options(self) -> dict:
        return {name: self.getOrDefault(name) for name in OPTIONS if self.isDefined(name)}


class IsotonicDistributionalRegressor(Estimator, _IdrParams, DefaultParamsReadable, DefaultParamsWritable):
    """fit(df) -> a model whose transform(df) adds prediction, cdf and thresholds."""

    def __init__(self, labelCol: str = "label", featureCols: list[str] | str = "feature", **options) -> None:
        super().__init__()
        unknown = set(options) - set(OPTIONS)
        if unknown:
            raise ConfigParseError(f"unknown options {sorted(unknown)}")
        self.setLabelCol(labelCol).setFeatureCols(featureCols)
        self._set(**{k: v for k, v in options.items() if v is not None})

    def setParams(self, **options) -> IsotonicDistributionalRegressor:
        unknown = set(options) - {"labelCol", "featureCols", *OPTIONS}
        if unknown:
            raise ConfigParseError(f"unknown options {sorted(unknown)}")
        if "featureCols" in options:
            self.setFeatureCols(options.pop("featureCols"))
        return self._set(**options)

    def _fit(self, df: DataFrame) -> IsotonicDistributionalRegressorModel:
        names = self.getFeatureCols()
        x = names[0] if len(names) == 1 and not self.isDefined("order") else names
        model = IsotonicDistributionalRegressorModel(fit_idr(df, self.getLabelCol(), x, **self._options()))
        return self._copyValues(model)


class _ModelWriter(MLWriter):
    def __init__(self, instance: IsotonicDistributionalRegressorModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.idr.save(f"{path}/idr")


class _ModelReader(MLReader):
    def load(self, path: str) -> IsotonicDistributionalRegressorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = IsotonicDistributionalRegressorModel(IDRModel.load(self.sparkSession, f"{path}/idr"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class IsotonicDistributionalRegressorModel(Model, _IdrParams, MLReadable, MLWritable):
    """transform adds prediction, cdf and thresholds; predict, cdf, cdf_at and quantiles are those of the IDRModel `idr`."""

    def __init__(self, idr: IDRModel | None = None) -> None:
        super().__init__()
        self.idr = idr

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.idr.predict_cdf(df).withColumn("prediction", C.mean(F.col("cdf"), F.col("thresholds")))

    predict = property(lambda self: self.idr.predict)
    cdf = property(lambda self: self.idr.predict_cdf)
    cdf_at = property(lambda self: self.idr.cdf_at)
    quantiles = property(lambda self: self.idr.quantile)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


