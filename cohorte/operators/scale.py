"""Standardisation with the population standard deviation (M4).

``pyspark.ml.feature.StandardScaler`` divides by the sample deviation; the
reference divides by the population one, so this is a small own stage:
one aggregate pass for mean and ``stddev_pop`` of every column, then a
projection. A constant column maps to 0.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PopulationScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "numeric columns", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "output suffix ('' = replace)", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, suffix: str = ""):
        super().__init__()
        self._setDefault(inputCols=[], suffix="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getOrDefault(self.inputCols)
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        stats = {c: [row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0] for c in cols}
        return self._copyValues(PopulationScalerModel(stats=json.dumps(stats)))


class PopulationScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "JSON {column: [mean, std]}", TypeConverters.toString)
    inputCols = PopulationScaler.inputCols
    suffix = PopulationScaler.suffix

    @keyword_only
    def __init__(self, stats: str = "{}"):
        super().__init__()
        self._setDefault(stats="{}", inputCols=[], suffix="")
        self._set(**self._input_kwargs)

    def get_stats(self) -> dict[str, list[float]]:
        return json.loads(self.getOrDefault(self.stats))

    def _transform(self, df: DataFrame) -> DataFrame:
        sfx = self.getOrDefault(self.suffix)
        out = {}
        for c, (m, s) in self.get_stats().items():
            x = F.col(c).cast("double")
            out[f"{c}{sfx}"] = F.lit(0.0) if s == 0 else (x - F.lit(m)) / F.lit(s)
        return df.withColumns(out)
