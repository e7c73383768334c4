"""Q5: clean one table with reports.

Per table a ``pyspark.ml.Pipeline`` of normaliser -> imputer -> winsoriser
is fitted in that order; the order is part of the result (quartiles are
taken after imputation). Fitting runs a few small aggregate jobs; the
cleaned table itself stays a lazy projection of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.operators.clean import (
    AdaptiveImputer,
    AdaptiveImputerModel,
    IQRWinsoriser,
    IQRWinsoriserModel,
    TextNormaliser,
    fit_together,
)
from cohorte.schemas import TABLES


def protected_columns(table: str, compat: bool = False) -> list[str]:
    """Keys and dates are not normalised by default; ``compat=True``
    normalises the id columns too, as the reference does."""
    spec = TABLES[table]
    keys = [spec.key] + ([spec.parent_key] if spec.parent_key else [])
    return list(spec.date_columns) + ([] if compat else keys)


def cleaning_pipeline(table: str, compat: bool = False, multiplier: float = 1.5) -> Pipeline:
    spec = TABLES[table]
    keys = [spec.key] + ([spec.parent_key] if spec.parent_key else [])
    return Pipeline(
        stages=[
            TextNormaliser(exclude=protected_columns(table, compat)),
            AdaptiveImputer(exclude=keys + list(spec.date_columns)),
            IQRWinsoriser(multiplier=multiplier, exclude=keys),
        ]
    )


@dataclass
class CleaningRun:
    table: str
    source: DataFrame
    model: PipelineModel

    @property
    def normaliser(self) -> TextNormaliser:
        return self.model.stages[0]

    @property
    def imputer(self) -> AdaptiveImputerModel:
        return self.model.stages[1]

    @property
    def winsoriser(self) -> IQRWinsoriserModel:
        return self.model.stages[2]

    def normalised(self) -> DataFrame:
        return self.normaliser.transform(self.source)

    def imputed(self) -> DataFrame:
        return self.imputer.transform(self.normalised())

    def cleaned(self) -> DataFrame:
        return self.model.transform(self.source)

    # reports, each tagged with the table name
    def _tag(self, df: DataFrame) -> DataFrame:
        return df.select(F.lit(self.table).alias("tabla"), *df.columns)

    def normalisation_report(self) -> DataFrame:
        return self._tag(self.normaliser.report(self.source))

    def normalisation_examples(self) -> DataFrame:
        return self._tag(self.normaliser.examples(self.source))

    def missing_report(self) -> DataFrame:
        return self._tag(self.imputer.report(self.source.sparkSession))

    def outlier_report(self) -> DataFrame:
        return self._tag(self.winsoriser.report(self.imputed()))

    def outlier_values(self) -> DataFrame:
        return self._tag(self.winsoriser.outlier_values(self.imputed()))

    def bounds(self) -> DataFrame:
        return self._tag(self.winsoriser.bounds_frame(self.source.sparkSession))

    def fill_values(self) -> DataFrame:
        import json

        fill = self.imputer.fill_values()
        strat = json.loads(self.imputer.getOrDefault(self.imputer.strategies))
        rows = [
            (c, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v), strat[c])
            for c, v in fill.items()
        ]
        df = self.source.sparkSession.createDataFrame(
            rows, "campo string, valor_texto string, valor_numerico double, estrategia string"
        )
        return self._tag(df)


def clean_table(df: DataFrame, table: str, compat: bool = False, multiplier: float = 1.5) -> CleaningRun:
    normaliser, imputer, winsoriser = cleaning_pipeline(table, compat, multiplier).getStages()
    # what the pipeline's fit gives, with the two fits sharing their counts
    fitted = fit_together(normaliser.transform(df), imputer, winsoriser)
    return CleaningRun(table, df, PipelineModel(stages=[normaliser, *fitted]))


def clean_all(tables: dict[str, DataFrame], compat: bool = False) -> dict[str, CleaningRun]:
    return {name: clean_table(df, name, compat) for name, df in tables.items()}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def combined_report(runs: dict[str, CleaningRun]) -> DataFrame:
    """One row per (step, table.column) with the records it affected."""
    parts = []
    for run in runs.values():
        n = run.normalisation_report()
        parts.append(n.select(F.lit("normalizacion").alias("paso"), F.concat_ws(".", "tabla", "campo").alias("campo"), F.col("registros_modificados").alias("registros")))
        m = run.missing_report()
        parts.append(m.select(F.lit("imputacion").alias("paso"), F.concat_ws(".", "tabla", "campo").alias("campo"), (F.col("total_registros") - F.col("valores_faltantes")).alias("registros")))
        o = run.outlier_report()
        parts.append(o.select(F.lit("outliers").alias("paso"), F.concat_ws(".", "tabla", "campo").alias("campo"), F.col("outliers_detectados").alias("registros")))
    return _union(parts)


def true_imputed_count(runs: dict[str, CleaningRun]) -> int:
    """Cells actually filled: null count at fit of every imputed column
    (fitted metadata, a few numbers per column)."""
    n = 0
    for r in runs.values():
        fill = r.imputer.fill_values()
        for c, s in r.imputer._get_json(r.imputer.stats).items():
            if c in fill and fill[c] is not None:
                n += int(s["nulos"])
    return n


def summary(runs: dict[str, CleaningRun]) -> DataFrame:
    """Fields processed and records per step, plus the total.

    ``registros`` repeats the reference's figures (for imputation that is
    the non-null rows after imputation, not the cells filled);
    ``registros_reales`` gives the true count of filled cells instead."""
    rep = combined_report(runs)
    filled = F.lit(true_imputed_count(runs)).cast("long")
    per_step = rep.groupBy("paso").agg(
        F.count("campo").alias("campos_procesados"), F.sum("registros").alias("registros")
    )
    per_step = per_step.withColumn(
        "registros_reales", F.when(F.col("paso") == "imputacion", filled).otherwise(F.col("registros"))
    )
    total = per_step.agg(
        F.lit("total").alias("paso"),
        F.sum("campos_procesados").alias("campos_procesados"),
        F.sum("registros").alias("registros"),
        F.sum("registros_reales").alias("registros_reales"),
    )
    return per_step.unionByName(total)
