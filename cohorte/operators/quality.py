"""Row-level quality checks: typed parsing with reasons, quarantine,
primary-key and foreign-key checks (I1-I10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorte.functions.dates import ColumnFormats, date_sql, infer_formats
from cohorte.functions.parse import (
    DEFAULT_DATE_FORMATS,
    lit_sql,
    optional_text_sql,
    parse_bool_sql,
    parse_date_sql,
    parse_double_sql,
    parse_int_sql,
    q,
    required_text_sql,
)
from cohorte.schemas import TableSpec

REASONS = "_motivos"

# Singular table names used in the error messages.
SINGULAR = {"paciente": "paciente", "consulta": "consulta", "laboratorio": "laboratorio"}


#: Formats tried on every date column, or the inferred ones of each column.
Formats = tuple[str, ...] | dict[str, ColumnFormats]
TYPED_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _parser_sql(f: T.StructField, formats: Formats, compat: bool, source: T.DataType | None = None) -> str:
    t = f.dataType
    if isinstance(t, T.DateType):
        if isinstance(source, TYPED_DATES):
            return f"CAST({q(f.name)} AS DATE)"  # typed sheet (e.g. Parquet): no text round trip
        if isinstance(formats, dict):
            return date_sql(f.name, formats[f.name])
        return parse_date_sql(f.name, formats)
    if isinstance(t, T.BooleanType):
        return parse_bool_sql(f.name, isinstance(source, T.NumericType))
    if isinstance(t, T.IntegerType):
        return parse_int_sql(f.name, "INT")
    if isinstance(t, T.LongType):
        return parse_int_sql(f.name, "BIGINT")
    if isinstance(t, T.DoubleType):
        return parse_double_sql(f.name)
    if f.nullable:
        return optional_text_sql(f.name)
    return required_text_sql(f.name, compat)


#: Prefix of a parsed cell beside the raw one.
PARSED = "_leido_"


def parse_sheet(
    raw: DataFrame,
    spec: TableSpec,
    formats: Formats = DEFAULT_DATE_FORMATS,
    compat: bool = False,
) -> DataFrame:
    """I1-I5 + I10: cast every raw cell to the declared type and collect the
    reasons a row cannot be stored (unparseable value, missing required
    value) in an array column. Nothing fails; nothing is dropped.

    Built as SQL expression text and sent in two ``selectExpr``: a cell is parsed
    once, its reason looks at what came out."""
    cols, reasons = [], []
    kept = [q(c) for c in raw.columns]
    source_types = {f.name: f.dataType for f in raw.schema.fields}
    for f in spec.schema.fields:
        parsed = _parser_sql(f, formats, compat, source_types.get(f.name))
        out = q(PARSED + f.name)
        kept.append(f"{parsed} AS {out}")
        cols.append(f"{out} AS {q(f.name)}")
        if f.name not in raw.columns:
            continue
        src = f"CAST({q(f.name)} AS STRING)"
        # Empty text and the text form of NaN are missing values
        present = f"({src} IS NOT NULL AND lower(trim({src})) NOT IN ('', 'nan'))"
        invalid = f"format_string({lit_sql(f.name + ': valor no válido ' + chr(39) + '%s' + chr(39))}, {src})"
        if compat and not f.nullable and isinstance(f.dataType, T.StringType):
            continue  # I3, compat: a missing text is stored as "nan", so nothing is wrong with the row
        if not f.nullable:
            reasons.append(
                f"CASE WHEN NOT {present} THEN {lit_sql(f.name + ': valor requerido ausente')} "
                f"WHEN {out} IS NULL THEN {invalid} END"
            )
        elif not isinstance(f.dataType, T.StringType):
            reasons.append(f"CASE WHEN {present} AND {out} IS NULL THEN {invalid} END")
    extra = [q(c) for c in raw.columns if c not in spec.columns]
    arr = f"array_compact(array({', '.join(reasons)}))" if reasons else "CAST(array() AS ARRAY<STRING>)"
    return raw.selectExpr(*kept).selectExpr(*cols, *extra, f"{arr} AS {REASONS}")


def sheet_formats(raw: DataFrame, spec: TableSpec, month_first: bool = False) -> dict[str, ColumnFormats]:
    """The formats of a sheet's date columns that arrive as text (one pass over the sheet)."""
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    return infer_formats(raw, [c for c in spec.date_columns if c in kinds and not isinstance(kinds[c], TYPED_DATES)], month_first)


def split_valid(parsed: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Good rows (declared columns only) and quarantined rows
    ``(tabla, clave, motivos, mensaje)``."""
    extra = [c for c in parsed.columns if c not in spec.columns and c != REASONS]
    good = parsed.where(f"size({REASONS}) = 0").select(*spec.columns, *extra)
    bad = quarantine_rows(parsed.where(f"size({REASONS}) > 0"), spec, F.col(REASONS))
    return good, bad


def quarantine_rows(df: DataFrame, spec: TableSpec, reasons: Column) -> DataFrame:
    key = F.coalesce(F.col(spec.key).cast("string"), F.lit("desconocido"))
    msg = F.format_string("Error en %s %s: %s", F.lit(SINGULAR[spec.name]), key, F.array_join(reasons, "; "))
    return df.select(F.lit(spec.name).alias("tabla"), key.alias("clave"), reasons.alias("motivos"), msg.alias("mensaje"))


def dedupe_last(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """I8: keep one row per key, the one with the greatest ``order_col``
    (last wins). An aggregate (``max_by``) rather than a window, so the rows
    of a hot key are combined map-side before the shuffle."""
    others = [c for c in df.columns if c != key]
    packed = f"max_by(struct({', '.join(q(c) for c in others)}), {q(order_col)}) AS _r"
    return df.groupBy(key).agg(F.expr(packed)).selectExpr(q(key), *[f"_r.{q(c)} AS {q(c)}" for c in others])


def pk_duplicates(df: DataFrame, key: str) -> DataFrame:
    """I8 check: keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copias")).where(F.col("copias") > 1)


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose parent does not exist. A left-anti join; AQE
    splits a skewed child partition (one patient with very many rows)."""
    parent_key = parent_key or fk
    keys = parent.select(F.col(parent_key).alias(fk))
    return child.join(keys, fk, "left_anti")
