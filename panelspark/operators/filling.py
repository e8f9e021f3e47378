"""An estimator for missing features: medians of the training rows, and a column that says where one was missing."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "the features", TypeConverters.toListString)
    filledSuffix = Param(Params._dummy(), "filledSuffix", "ends the names of the filled features", TypeConverters.toString)
    missingSuffix = Param(Params._dummy(), "missingSuffix", "ends the names of the columns of 1 where a feature is missing, else 0", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(filledSuffix="_filled", missingSuffix="_missing")

    def outputs(self) -> list[str]:
        """The filled features, then the columns that say where each was missing."""
        names = self.getOrDefault(self.inputCols)
        return [n + self.getOrDefault(s) for s in (self.filledSuffix, self.missingSuffix) for n in names]


class MedianFill(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the median of each feature's finite values; a feature without any gets ``fallback``.

    The sketches behind ``accuracy`` are of bounded size and merge, so one pass over the rows is enough.
    """

    fallback = Param(Params._dummy(), "fallback", "fills a feature that no training row has", TypeConverters.toFloat)
    accuracy = Param(Params._dummy(), "accuracy", "the median's rank is off by a share of 1 / accuracy at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, fallback=0.0, accuracy=10_000, filledSuffix="_filled", missingSuffix="_missing"):
        super().__init__()
        self._setDefault(fallback=0.0, accuracy=10_000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianFillModel:
        names = self.getOrDefault(self.inputCols)
        middle = lambda n: F.percentile_approx(finite(n), 0.5, self.getOrDefault(self.accuracy))
        row = dataset.agg(*[middle(n).alias(str(i)) for i, n in enumerate(names)]).first() if names else ()
        medians = [float(self.getOrDefault(self.fallback) if v is None else v) for v in row]
        model = MedianFillModel()
        for p in (self.inputCols, self.filledSuffix, self.missingSuffix):
            model._set(**{p.name: self.getOrDefault(p)})
        return model._set(medians=medians)._resetUid(self.uid)


class MedianFillModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Beside each feature its filled form and whether it was missing."""

    medians = Param(Params._dummy(), "medians", "what fills each feature", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, medians = self.getOrDefault(self.inputCols), self.getOrDefault(self.medians)
        filled = [F.coalesce(finite(n), F.lit(m)) for n, m in zip(names, medians, strict=True)]
        missing = [finite(n).isNull().cast("double") for n in names]
        return dataset.select("*", *[c.alias(n) for c, n in zip([*filled, *missing], self.outputs(), strict=True)])


def finite(name: str):
    """The column as a double, null where it is no finite number."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(F.abs(x) < float("inf"), x)
