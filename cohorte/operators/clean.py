"""Cleaning stages (C1-C15) as ``pyspark.ml`` Estimators/Transformers.

* :class:`TextNormaliser` (C1/C2) - transformer, no state.
* :class:`AdaptiveImputer` (C4-C7) - fit = one pass for null counts, one
  pass for the modes/medians that are needed; model = ``{column: value}``.
* :class:`IQRWinsoriser` (C8-C10) - fit = one pass of quartiles for all
  numeric columns; model = bounds per column.

Every ``transform`` is a pure projection (no action), so the fitted stages
run unchanged on batch and streaming DataFrames. Fitting only ever brings a
handful of numbers per column to the driver. Reports are separate methods
that return DataFrames.

Scale notes: medians and quartiles are exact at any size
(:mod:`cohorte.operators.order_stats`: counts per value in ranges of the
value). Modes are computed as a distributed ``groupBy(column, value)`` + top-1
per column, never as an in-memory map of all values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorte.functions.numeric import clip, nan_to_null, round_to
from cohorte.functions.text import normalise_text
from cohorte.operators.order_stats import exact_quantiles, quantiles_of_ranges, written_ranges

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Per-column defaults of the adaptive imputer (C5) and the
# null-rate boundary (in percent) between "mode/median" and "high rate".
IMPUTE_DEFAULTS: dict[str, Any] = {
    "zona_residencia": "Desconocida",
    "resultado": "Sin resultado",
    "unidad": "N/a",
    "resultado_numerico": 0.0,
}
HIGH_NULL_RATE = 20.0
# Action texts of the missing-value report.
ACTION_TEXT = "Imputados con '{value}' ({nulls} registros)"
ACTION_ZERO = "Imputados con 0 ({nulls} registros) - alta tasa de faltantes ({pct:.1f}%)"
ACTION_MEDIAN = "Imputados con mediana ({value:.2f}) - {nulls} registros"
ACTION_LEFT = "No imputado (categórico) - porcentaje alto ({pct:.2f}%). Requiere análisis manual"
ACTION_NONE = "No requiere imputación - sin valores faltantes"


def text_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """String columns of the schema, minus ``exclude``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Numeric (not boolean) columns of the schema, minus ``exclude``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def _stack(df: DataFrame, cols: list[str], value_type: str = "string") -> DataFrame:
    """Unpivot ``cols`` into (campo, valor) rows - one pass for all columns."""
    return df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast(value_type).alias("valor")) for c in cols])
        ).alias("s")
    ).select("s.campo", "s.valor")


class _Json(Params):
    """Helper for JSON-valued params (fitted state that must persist)."""

    def _get_json(self, p: Param) -> Any:
        return json.loads(self.getOrDefault(p))


# --------------------------------------------------------------------------
# C1 / C2 / C3
# --------------------------------------------------------------------------


class TextNormaliser(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Normalise every text column (C1) except ``exclude`` (keys, dates)."""

    columns = Param(Params._dummy(), "columns", "text columns ([] = all string columns)", TypeConverters.toListString)
    exclude = Param(Params._dummy(), "exclude", "columns never touched", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns: list[str] | None = None, exclude: list[str] | None = None):
        super().__init__()
        self._setDefault(columns=[], exclude=[])
        self._set(**self._input_kwargs)

    def target_columns(self, df: DataFrame) -> list[str]:
        cols = self.getOrDefault(self.columns) or text_columns(df)
        excl = set(self.getOrDefault(self.exclude))
        return [c for c in cols if c in df.columns and c not in excl]

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = set(self.target_columns(df))
        return df.select(*[normalise_text(c).alias(c) if c in cols else F.col(c) for c in df.columns])

    def report(self, df: DataFrame) -> DataFrame:
        """Per changed column: rows modified, distinct values before and
        after. One shuffle for all columns: (campo, valor) counts."""
        cols = self.target_columns(df)
        counts = _stack(df, cols).where(F.col("valor").isNotNull()).groupBy("campo", "valor").count()
        counts = counts.withColumn("nuevo", normalise_text("valor"))
        changed = ~F.col("valor").eqNullSafe(F.col("nuevo"))
        return (
            counts.groupBy("campo")
            .agg(
                F.sum(F.when(changed, F.col("count")).otherwise(0)).alias("registros_modificados"),
                F.count("valor").alias("valores_unicos_antes"),
                F.count_distinct("nuevo").alias("valores_unicos_despues"),
                F.count_if(changed).alias("_n_changed"),
            )
            .where(F.col("_n_changed") > 0)
            .drop("_n_changed")
        )

    def examples(self, df: DataFrame, k: int = 5) -> DataFrame:
        """C3 examples: the ``k`` smallest changed original values per column
        with their normalised form. ``row_number() <= k`` is planned with a
        per-partition group limit, so no column's values meet in one task."""
        cols = self.target_columns(df)
        vals = (
            _stack(df, cols)
            .where(F.col("valor").isNotNull())
            .distinct()
            .withColumn("valor_normalizado", normalise_text("valor"))
            .where(~F.col("valor").eqNullSafe(F.col("valor_normalizado")))
        )
        w = Window.partitionBy("campo").orderBy("valor")
        return (
            vals.withColumn("orden", F.row_number().over(w))
            .where(F.col("orden") <= k)
            .select("campo", "orden", F.col("valor").alias("valor_original"), "valor_normalizado")
        )


def examples_map(examples: DataFrame) -> DataFrame:
    """C3 in the reference's shape: one row per column with
    ``ejemplos_cambios`` as a map old -> new. Built from the at most k rows
    per column of :meth:`TextNormaliser.examples`, so the collect is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("orden", "valor_original", "valor_normalizado")))
    return examples.groupBy("campo").agg(
        F.map_from_arrays(
            F.transform(ordered, lambda e: e["valor_original"]),
            F.transform(ordered, lambda e: e["valor_normalizado"]),
        ).alias("ejemplos_cambios")
    )


# --------------------------------------------------------------------------
# C4 - C7
# --------------------------------------------------------------------------


def null_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4: rows, nulls and percentage per column, one pass for all columns.
    NaN counts as missing (pandas ``isna``)."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}

    def missing(c: str):
        col = F.col(c)
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            return col.isNull() | F.isnan(col)
        return col.isNull()

    row = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(missing(c)).alias(c) for c in cols]
    )
    stacked = row.select(
        F.col("_total").alias("total_registros"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("nulos")) for c in cols])).alias("s"),
    )
    return stacked.select(
        "s.campo",
        "total_registros",
        F.col("s.nulos").alias("valores_nulos"),
        F.when(F.col("total_registros") > 0, F.col("s.nulos") * 100.0 / F.col("total_registros"))
        .otherwise(F.lit(0.0))
        .alias("porcentaje"),
    )


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> lowest value.
    Distributed: count per (campo, valor), then top-1 per column."""
    if not cols:
        return df.sparkSession.createDataFrame([], "campo string, valor string")
    counts = _stack(df, cols).where(F.col("valor").isNotNull()).groupBy("campo", "valor").count()
    w = Window.partitionBy("campo").orderBy(F.col("count").desc(), F.col("valor"))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("campo", "valor")


# Fitted quantiles are kept to this many decimals: interpolation between two
# order statistics is computed differently by different engines (Spark
# gives 356.32500000000005 where others give 356.325), and the bounds must
# not depend on that last bit.
QUANTILE_DIGITS = 9


def _quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float]]:
    return {c: [round(v, QUANTILE_DIGITS) for v in q] for c, q in exact_quantiles(df, probs).items()}


class AdaptiveImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Per column with nulls: a fixed default wins at any rate; below
    ``threshold`` % the mode (text, ties -> lowest) or the median (numbers);
    at or above it numbers get 0.0 and text stays NULL."""

    defaults = Param(Params._dummy(), "defaults", "JSON {column: default}", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "high-null-rate boundary in %", TypeConverters.toFloat)
    exclude = Param(Params._dummy(), "exclude", "columns never imputed", TypeConverters.toListString)

    @keyword_only
    def __init__(self, defaults: str | None = None, threshold: float = HIGH_NULL_RATE, exclude: list[str] | None = None):
        super().__init__()
        self._setDefault(defaults=json.dumps(IMPUTE_DEFAULTS), threshold=HIGH_NULL_RATE, exclude=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "AdaptiveImputerModel":
        excl = set(self.getOrDefault(self.exclude))
        cols = [c for c in df.columns if c not in excl]
        types = {f.name: f.dataType for f in df.schema.fields}
        rates = {r["campo"]: r.asDict() for r in null_rates(df, cols).collect()}  # one row per column
        modes = lambda need: {r["campo"]: r["valor"] for r in column_modes(df, need).collect()}
        medians = lambda need: {c: q[0] for c, q in _quantiles(df, {c: [0.5] for c in need}).items()}
        return self._chosen(rates, types, cols, modes, medians)

    def _chosen(self, rates: dict[str, dict], types: dict[str, T.DataType], cols: list[str], modes: Callable, medians: Callable) -> "AdaptiveImputerModel":
        """The model for null rates; ``modes`` and ``medians`` are asked once, for the columns that need one."""
        defaults = json.loads(self.getOrDefault(self.defaults))
        thr = self.getOrDefault(self.threshold)
        total = next(iter(rates.values()))["total_registros"] if rates else 0
        fill: dict[str, Any] = {}
        strategy: dict[str, str] = {}
        need_mode, need_median = [], []
        for c in cols:
            pct = rates[c]["porcentaje"]
            if not pct or pct <= 0:
                continue
            is_text = isinstance(types[c], T.StringType)
            is_num = isinstance(types[c], NUMERIC_TYPES)
            if c in defaults:
                fill[c], strategy[c] = defaults[c], "defecto"
            elif pct < thr:
                if is_text:
                    need_mode.append(c)
                elif is_num:
                    need_median.append(c)
            elif is_num:
                fill[c], strategy[c] = 0.0, "cero"
            else:
                strategy[c] = "sin_imputar"
        found = modes(need_mode) if need_mode else {}
        middle = medians(need_median) if need_median else {}
        for c, v in found.items():
            fill[c], strategy[c] = v, "moda"
        for c, v in middle.items():
            fill[c], strategy[c] = float(v), "mediana"
        stats = {c: {"nulos": rates[c]["valores_nulos"], "porcentaje": rates[c]["porcentaje"]} for c in cols if rates[c]["valores_nulos"]}
        model = AdaptiveImputerModel(
            fillValues=json.dumps(fill), strategies=json.dumps(strategy), stats=json.dumps(stats), total=int(total)
        )
        return self._copyValues(model)


class AdaptiveImputerModel(Model, _Json, DefaultParamsReadable, DefaultParamsWritable):
    fillValues = Param(Params._dummy(), "fillValues", "JSON {column: value}", TypeConverters.toString)
    strategies = Param(Params._dummy(), "strategies", "JSON {column: strategy}", TypeConverters.toString)
    stats = Param(Params._dummy(), "stats", "JSON {column: {nulos, porcentaje}} at fit", TypeConverters.toString)
    total = Param(Params._dummy(), "total", "rows at fit", TypeConverters.toInt)
    defaults = AdaptiveImputer.defaults
    threshold = AdaptiveImputer.threshold
    exclude = AdaptiveImputer.exclude

    @keyword_only
    def __init__(self, fillValues: str = "{}", strategies: str = "{}", stats: str = "{}", total: int = 0):
        super().__init__()
        self._setDefault(fillValues="{}", strategies="{}", stats="{}", total=0, threshold=HIGH_NULL_RATE)
        self._set(**self._input_kwargs)

    def fill_values(self) -> dict[str, Any]:
        return self._get_json(self.fillValues)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Fill with the fitted values, keeping each column's type (an
        integer column gets its median rounded half-even)."""
        fill = self.fill_values()
        types = {f.name: f.dataType for f in df.schema.fields}
        out = []
        for c in df.columns:
            if c in fill and fill[c] is not None:
                t = types[c]
                if isinstance(t, INTEGRAL_TYPES):
                    v = F.bround(F.lit(float(fill[c])), 0).cast(t)
                elif isinstance(t, (T.FloatType, T.DoubleType)):
                    out.append(F.coalesce(nan_to_null(c), F.lit(float(fill[c]))).cast(t).alias(c))
                    continue
                else:
                    v = F.lit(fill[c]).cast(t)
                out.append(F.coalesce(F.col(c), v).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    def report(self, spark: SparkSession | None = None) -> DataFrame:
        """Only columns that had nulls: rows, nulls left after, % left
        (2 dp) and the action text. Built from the fit statistics alone (the
        fill values are non-null, so an imputed column has none left)."""
        spark = spark or SparkSession.getActiveSession()
        fill, strat, stats = self.fill_values(), self._get_json(self.strategies), self._get_json(self.stats)
        total = self.getOrDefault(self.total)
        texts = {"moda": ACTION_TEXT, "cero": ACTION_ZERO, "mediana": ACTION_MEDIAN}
        rows = []
        for c, s in stats.items():
            how, value = strat.get(c, "sin_imputar"), fill.get(c)
            if how == "defecto":  # a fixed default reads like the fill of its kind
                high = s["porcentaje"] >= self.getOrDefault("threshold")
                how_text = ACTION_TEXT if isinstance(value, str) else ACTION_ZERO if high else ACTION_MEDIAN
            else:
                how_text = texts.get(how, ACTION_LEFT if s["porcentaje"] >= self.getOrDefault("threshold") else ACTION_NONE)
            left = s["nulos"] if value is None else 0
            action = how_text.format(value=value, nulls=s["nulos"], pct=s["porcentaje"])
            rows.append((c, int(total), int(left), round(left / total * 100, 2) if total else 0.0, action, how))
        schema = "campo string, total_registros long, valores_faltantes long, porcentaje_faltante double, recomendacion string, estrategia string"
        return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------
# C8 - C10
# --------------------------------------------------------------------------


class IQRWinsoriser(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Bounds ``Q1 - k*IQR``, ``Q3 + k*IQR`` per numeric column with at
    least one value (quartiles by linear interpolation)."""

    multiplier = Param(Params._dummy(), "multiplier", "IQR multiplier", TypeConverters.toFloat)
    exclude = Param(Params._dummy(), "exclude", "columns never clipped", TypeConverters.toListString)

    @keyword_only
    def __init__(self, multiplier: float = 1.5, exclude: list[str] | None = None):
        super().__init__()
        self._setDefault(multiplier=1.5, exclude=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "IQRWinsoriserModel":
        cols = numeric_columns(df, self.getOrDefault(self.exclude))
        return self._chosen(_quantiles(df, {c: [0.25, 0.75] for c in cols}) if cols else {})

    def _chosen(self, quartiles: dict[str, list[float]]) -> "IQRWinsoriserModel":
        k = self.getOrDefault(self.multiplier)
        bounds: dict[str, dict[str, float]] = {}
        for c, (q1, q3) in quartiles.items():
            iqr = q3 - q1
            bounds[c] = {"q1": q1, "q3": q3, "iqr": iqr, "inferior": q1 - k * iqr, "superior": q3 + k * iqr}
        return self._copyValues(IQRWinsoriserModel(bounds=json.dumps(bounds)))


def fit_together(df: DataFrame, imputer: AdaptiveImputer, winsoriser: IQRWinsoriser) -> tuple[AdaptiveImputerModel, "IQRWinsoriserModel"]:
    """C5 and C8 fitted on the same rows: what the two ``fit`` calls give, from two
    passes over them.

    The first counts missing cells. The second counts each value of the columns
    that need a mode, a median or quartiles, once, into ranges. Quartiles after
    imputation follow from the same counts, as the fill adds its value so many times."""
    types = {f.name: f.dataType for f in df.schema.fields}
    excl = set(imputer.getOrDefault(imputer.exclude))
    cols = [c for c in df.columns if c not in excl]
    rates = {r["campo"]: r.asDict() for r in null_rates(df, cols).collect()}  # one row per column
    numeric = numeric_columns(df, winsoriser.getOrDefault(winsoriser.exclude))
    held: dict[str, DataFrame] = {}

    def counts(texts: list[str]) -> DataFrame:
        if "n" not in held:
            null = F.lit(None)
            cells = [F.struct(F.lit(c).alias("campo"), null.cast("string").alias("texto"), nan_to_null(F.col(c).cast("double")).alias("valor")) for c in numeric]
            cells += [F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("texto"), null.cast("double").alias("valor")) for c in texts]
            rows = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("texto IS NOT NULL OR valor IS NOT NULL")
            held["n"] = written_ranges(rows.groupBy("campo", "valor", "texto").agg(F.count(F.lit(1)).alias("n")), "campo", "valor", "texto")
        return held["n"]

    def modes(need: list[str]) -> dict[str, str]:
        rows = counts(need).where("texto IS NOT NULL").groupBy("campo").agg(F.min_by("texto", F.struct(-F.col("n"), "texto")).alias("valor"))
        return {r["campo"]: r["valor"] for r in rows.collect()}  # one row per column

    def quantiles(probs: dict[str, list[float]], extra: dict[str, tuple[float, int]] | None = None) -> dict[str, list[float]]:
        found = quantiles_of_ranges(counts([]).where("valor IS NOT NULL"), probs, extra)
        return {c: [round(v, QUANTILE_DIGITS) for v in q] for c, q in found.items()}

    fills = imputer._chosen(rates, types, cols, modes, lambda need: {c: q[0] for c, q in quantiles({c: [0.5] for c in need}).items()})
    added = {}
    for c, v in fills.fill_values().items():
        if c in numeric and v is not None:
            # an integer column gets its fill rounded half to even
            added[c] = (float(round(float(v))) if isinstance(types[c], INTEGRAL_TYPES) else float(v), rates[c]["valores_nulos"])
    return fills, winsoriser._chosen(quantiles({c: [0.25, 0.75] for c in numeric}, added) if numeric else {})


class IQRWinsoriserModel(Model, _Json, DefaultParamsReadable, DefaultParamsWritable):
    bounds = Param(Params._dummy(), "bounds", "JSON {column: {q1,q3,iqr,inferior,superior}}", TypeConverters.toString)
    multiplier = IQRWinsoriser.multiplier
    exclude = IQRWinsoriser.exclude

    @keyword_only
    def __init__(self, bounds: str = "{}"):
        super().__init__()
        self._setDefault(bounds="{}")
        self._set(**self._input_kwargs)

    def get_bounds(self) -> dict[str, dict[str, float]]:
        return self._get_json(self.bounds)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Clip; NULL stays NULL. Integer columns are rounded back
        (half-even) to their declared type."""
        b = self.get_bounds()
        types = {f.name: f.dataType for f in df.schema.fields}
        out = []
        for c in df.columns:
            if c in b:
                v = clip(nan_to_null(F.col(c).cast("double")), b[c]["inferior"], b[c]["superior"])
                if isinstance(types[c], INTEGRAL_TYPES):
                    v = F.bround(v, 0)
                out.append(v.cast(types[c]).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    def bounds_frame(self, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or SparkSession.getActiveSession()
        rows = [(c, v["q1"], v["q3"], v["iqr"], v["inferior"], v["superior"]) for c, v in self.get_bounds().items()]
        return spark.createDataFrame(rows, "campo string, q1 double, q3 double, iqr double, limite_inferior double, limite_superior double")

    def report(self, df: DataFrame) -> DataFrame:
        """Per clipped column (measured on the input, before clipping):
        non-null rows, quartiles and bounds (2 dp), outliers strictly
        outside the bounds and their share of the non-null rows. One pass."""
        b = self.get_bounds()
        if not b:
            return df.sparkSession.createDataFrame([], "campo string, total_registros long, q1 double, q3 double, iqr double, limite_inferior double, limite_superior double, outliers_detectados long, porcentaje_outliers double")
        aggs = []
        for c, v in b.items():
            x = nan_to_null(F.col(c).cast("double"))
            aggs += [
                F.count(x).alias(f"n_{c}"),
                F.count_if((x < F.lit(v["inferior"])) | (x > F.lit(v["superior"]))).alias(f"o_{c}"),
            ]
        row = df.agg(*aggs)
        parts = []
        for c, v in b.items():
            n, o = F.col(f"n_{c}"), F.col(f"o_{c}")
            parts.append(
                row.select(
                    F.lit(c).alias("campo"),
                    n.alias("total_registros"),
                    *[round_to(F.lit(v[key]), 2).alias(name) for key, name in (("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"), ("inferior", "limite_inferior"), ("superior", "limite_superior"))],
                    o.alias("outliers_detectados"),
                    round_to(F.when(n > 0, o * 100.0 / n).otherwise(F.lit(0.0)), 2).alias("porcentaje_outliers"),
                )
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def outlier_values(self, df: DataFrame, k: int = 20) -> DataFrame:
        """The ``k`` smallest outlier values per column, long format
        (campo, orden, valor); a per-partition group limit keeps it bounded."""
        b = self.get_bounds()
        if not b:
            return df.sparkSession.createDataFrame([], "campo string, orden int, valor double")
        # one scan for all columns: a column's value is kept where it lies outside its bounds
        cells = []
        for c, v in b.items():
            x = nan_to_null(F.col(c).cast("double"))
            outside = (x < F.lit(v["inferior"])) | (x > F.lit(v["superior"]))
            cells.append(F.when(outside, F.struct(F.lit(c).alias("campo"), x.alias("valor"))))
        out = df.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.campo", "s.valor")
        w = Window.partitionBy("campo").orderBy("valor")
        return out.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= k).select("campo", "orden", "valor")


# --------------------------------------------------------------------------
# C14
# --------------------------------------------------------------------------


def residual_counts(df: DataFrame) -> list:
    """C14: how many numeric cells of each column are NULL or NaN (aggregates)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    nan = lambda c: F.isnan(c) if isinstance(types[c], (T.FloatType, T.DoubleType)) else F.lit(False)
    return [F.count_if(F.col(c).isNull() | nan(c)).alias(c) for c in numeric_columns(df)]


def fill_residual_missing(df: DataFrame) -> DataFrame:
    """C14: NULL/NaN left in numeric columns of the feature table become 0
    (a safety net; the feature query already emits none). Lazy: no count
    is forced here."""
    cols = numeric_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    fixed = {}
    for c in cols:
        x = nan_to_null(F.col(c)) if isinstance(types[c], (T.FloatType, T.DoubleType)) else F.col(c)
        fixed[c] = F.coalesce(x, F.lit(0)).cast(types[c])
    return df.withColumns(fixed) if fixed else df


def outlier_lists(values: DataFrame) -> DataFrame:
    """C10 in the reference's shape: ``valores_outliers`` as an ascending
    list per column, from the at most 20 rows per column of
    :meth:`IQRWinsoriserModel.outlier_values` (bounded collect)."""
    ordered = F.array_sort(F.collect_list(F.struct("orden", "valor")))
    return values.groupBy("campo").agg(F.transform(ordered, lambda e: e["valor"]).alias("valores_outliers"))
