"""Cleaning as a fitted stage: an MLlib estimator whose model keeps the medians and bounds.

``SensorCleaner`` learns the statistics of ``cleaning.fit_stats`` from the rows it is given, the training rows
only, so nothing of validation or test data enters them. ``SensorCleanerModel`` is a projection with about
twenty stored numbers: it works alike on tables, on streams and as the first stage of a saved pipeline, and never
scans its input for statistics.

Defined results: a sensor without any training value is left as it is; nulls stay null where there is no median.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from shopfloor.functions.constants import CleaningParams
from shopfloor.operators import cleaning


class _CleanerParams(Params):
    sensors = Param(Params._dummy(), "sensors", "columns filled with their median", TypeConverters.toListString)
    capped = Param(Params._dummy(), "capped", "columns capped by their interquartile range", TypeConverters.toListString)
    iqrFactor = Param(Params._dummy(), "iqrFactor", "width of the caps", TypeConverters.toFloat)
    flags = Param(Params._dummy(), "flags", "add <column>_outlier flags", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        p = CleaningParams()
        self._setDefault(sensors=list(p.sensors), capped=list(p.capped), iqrFactor=float(p.iqr_factor), flags=False)

    def cleaning_params(self) -> CleaningParams:
        return CleaningParams(sensors=tuple(self.getOrDefault(self.sensors)), capped=tuple(self.getOrDefault(self.capped)),
                              iqr_factor=self.getOrDefault(self.iqrFactor))


class SensorCleaner(Estimator, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, sensors=None, capped=None, iqrFactor=None, flags=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SensorCleanerModel:
        stats = cleaning.fit_stats(dataset, self.cleaning_params())
        model = SensorCleanerModel()
        self._copyValues(model)
        model._set(statistics=json.dumps(stats, sort_keys=True))
        return model


class SensorCleanerModel(Model, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    statistics = Param(Params._dummy(), "statistics", "fitted statistics as JSON", TypeConverters.toString)

    @property
    def fitted(self) -> dict:
        """``nulls_c``, ``med_c``, ``q1_c``, ``q3_c``, ``lo_c``, ``hi_c`` of the training rows."""
        return json.loads(self.getOrDefault(self.statistics))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stats = self.fitted
        # a sensor without gaps in training may have some later: the median fills them as well
        always = {k: 1 if k.startswith("nulls_") else v for k, v in stats.items()}
        return cleaning.impute_and_cap(dataset, self.cleaning_params(), self.getOrDefault(self.flags), always)
