"""Fitted transforms as pyspark.ml stages: fit, transform, and save and load with their parameters as JSON."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tessera.operators.mlpanel import apply_preprocessor, apply_robust, fit_fold_preprocessor, fit_robust


class _Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose whole state is a small table, kept as JSON rows in the parameter `fitted`; saved with the other parameters."""

    fitted = Param(Params._dummy(), "fitted", "rows of the fitted table as JSON", TypeConverters.toListString)
    schema = Param(Params._dummy(), "schema", "fields of the fitted table", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()

    def table(self, spark) -> DataFrame:
        """The fitted table."""
        rows = spark.createDataFrame([(r,) for r in self.getOrDefault(self.fitted)], "r string")
        return rows.select(F.from_json("r", self.getOrDefault(self.schema)).alias("r")).select("r.*")


def _filled(model: _Fitted, fitted: DataFrame, most: int) -> _Fitted:
    rows = fitted.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} fitted rows; keep such a table as Parquet and use the operators themselves")
    model._set(fitted=sorted(rows), schema=", ".join(f"`{n}` {t}" for n, t in fitted.dtypes))
    return model


class RobustScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median and MAD of each feature over the dates start..end; the model adds `scaled`. Features whose MAD is zero are left out.

    The model holds a row a feature and refuses more than `most`."""

    start = Param(Params._dummy(), "start", "first decision date", TypeConverters.toString)
    end = Param(Params._dummy(), "end", "last decision date", TypeConverters.toString)
    valueCol = Param(Params._dummy(), "valueCol", "column of values", TypeConverters.toString)
    byCol = Param(Params._dummy(), "byCol", "column of features", TypeConverters.toString)
    most = Param(Params._dummy(), "most", "most fitted rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, start: str | None = None, end: str | None = None, valueCol: str = "value", byCol: str = "feature_name", most: int = 10_000) -> None:
        super().__init__()
        self._setDefault(valueCol="value", byCol="feature_name", most=10_000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RobustScalerModel:
        of = self.getOrDefault
        fitted = fit_robust(dataset, of(self.start), of(self.end), of(self.valueCol), of(self.byCol))
        model = _filled(RobustScalerModel(), fitted, of(self.most))
        return model._set(valueCol=of(self.valueCol), byCol=of(self.byCol))


class RobustScalerModel(_Fitted):
    valueCol = RobustScaler.valueCol
    byCol = RobustScaler.byCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_robust(dataset, self.table(dataset.sparkSession), self.getOrDefault("valueCol"), self.getOrDefault("byCol"))


class FoldPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Medians, clipping bounds, means and deviations of each fold's training rows; the model adds the prepared vector `x`.

    Fits on rows of role train that are not purged, and prepares all rows of the folds."""

    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)
    most = Param(Params._dummy(), "most", "most fitted rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, lower: float = 0.01, upper: float = 0.99, most: int = 10_000) -> None:
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99, most=10_000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FoldPreprocessorModel:
        train = dataset.where("role = 'train' and not purged")
        return _filled(FoldPreprocessorModel(), fit_fold_preprocessor(train, self.getOrDefault(self.lower), self.getOrDefault(self.upper)), self.getOrDefault(self.most))


class FoldPreprocessorModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_preprocessor(dataset, self.table(dataset.sparkSession))
