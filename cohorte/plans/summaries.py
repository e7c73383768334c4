"""Kept-up patient summaries: Q1-Q4 without reading all visits and labs again.

Two tables of the keyed store, dealt by patient into the same cells:

``resumen_dia``
    one row per patient, kind of row and day: how many rows, and per measure
    (all results, and each test bucket) number and sum of the results. All of it
    can be added and taken away, so a delivery adds its rows and takes away the
    rows that they replace.
``resumen``
    one row per patient: counts, sums, first and last dates, added up from the
    patient's days. First and last dates can't be taken away from; they follow
    from the days that are left.

A delivery changes only the cells of the patients that its rows name, old or new,
in the same commit as the tables themselves. A patient has at most one row per day
and kind, however many visits, so a frequent patient stays small.

Sums are exact: results are added as decimals (9 places, 29 digits before the
point); larger ones, which no lab gives, have a sum of their own in doubles.
"""

from __future__ import annotations

import os
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.functions.labels import months_back
from cohorte.functions.numeric import nan_to_null
from cohorte.functions.text import contains_any
from cohorte.operators.rollup import KEY, TEST_BUCKETS
from cohorte.schemas import TABLES
from cohorte.sources import store
from cohorte.sources.store import Change, Snapshot, Work

DAYS, PATIENTS = "resumen_dia", "resumen"
CHILDREN = ("consulta", "laboratorio")
ALL = "avg_resultado_numerico"
#: Measure -> patterns of the test's name (none: every test).
MEASURES: dict[str, tuple[str, ...]] = {ALL: (), **dict(TEST_BUCKETS)}
_SUM = "decimal(38,9)"


def _parts(measure: str) -> tuple[str, str, str]:
    return f"n_{measure}", f"suma_{measure}", f"grande_{measure}"


COUNTS = ["filas", *(f"n_{m}" for m in MEASURES)]
SUMS = [f"suma_{m}" for m in MEASURES]
LARGE = [f"grande_{m}" for m in MEASURES]


def _added_up() -> list[Column]:
    return (
        [F.sum(c).cast("long").alias(c) for c in COUNTS]
        + [F.sum(c).cast(_SUM).alias(c) for c in SUMS]
        + [F.sum(c).alias(c) for c in LARGE]
    )


def day_rows(name: str, rows: DataFrame, sign: int = 1) -> DataFrame:
    """Rows of a child table as what they add to (or, with -1, take from) their patient's days; not yet grouped."""
    when = F.col(TABLES[name].date_columns[0])
    value = nan_to_null("resultado_numerico") if name == "laboratorio" else F.lit(None).cast("double")
    exact = F.expr(f"try_cast(_v AS {_SUM})")
    out = rows.select(F.col(KEY), F.lit(name).alias("clase"), when.alias("fecha"), value.alias("_v"), (F.col("tipo_prueba") if name == "laboratorio" else F.lit(None).cast("string")).alias("_tipo"))
    cols = [F.lit(sign).cast("long").alias("filas")]
    for m, patterns in MEASURES.items():
        mine = F.col("_v").isNotNull() & (contains_any(F.col("_tipo"), patterns) if patterns else F.lit(True))
        n, total, large = _parts(m)
        cols += [
            F.when(mine, sign).otherwise(0).cast("long").alias(n),
            F.when(mine & exact.isNotNull(), exact * sign).otherwise(0).cast(_SUM).alias(total),
            F.when(mine & exact.isNull(), F.col("_v") * sign).otherwise(0.0).alias(large),
        ]
    return out.select(KEY, "clase", "fecha", *cols)


def grouped_days(rows: DataFrame) -> DataFrame:
    """One row per patient, kind and day; days without rows are gone."""
    cols = [KEY, "clase", "fecha", *COUNTS, *SUMS, *LARGE]
    return rows.groupBy(KEY, "clase", "fecha").agg(*_added_up()).where("filas <> 0").select(*cols)


def patient_rows(days: DataFrame) -> DataFrame:
    """``resumen`` from the days."""
    visit, lab = F.col("clase") == "consulta", F.col("clase") == "laboratorio"
    aggs = [
        F.sum(F.when(visit, F.col("filas")).otherwise(0)).cast("long").alias("count_consultas"),
        F.min(F.when(visit, F.col("fecha"))).alias("primera_consulta"),
        F.max(F.when(visit, F.col("fecha"))).alias("ultima_consulta"),
        F.sum(F.when(lab, F.col("filas")).otherwise(0)).cast("long").alias("count_laboratorios"),
        F.min(F.when(lab, F.col("fecha"))).alias("primera_fecha_lab"),
        F.max(F.when(lab, F.col("fecha"))).alias("ultima_fecha_lab"),
    ]
    return days.groupBy(KEY).agg(*aggs, *[c for c in _added_up()[1:]])


def summary_changes(
    spark: SparkSession, root: str, at: Snapshot, good: dict[str, tuple[DataFrame, int]], n_cells: int
) -> Work:
    """Changes of both summaries for a delivery's good rows, against the version it is merged into."""
    delta, reads = None, {}
    for name in CHILDREN:
        if name not in good:
            continue
        rows, n_rows = good[name]
        part = day_rows(name, rows)
        if name in at.tables:
            key = TABLES[name].key
            part = part.unionByName(day_rows(name, store.delta(at, root, rows, name, key, n_rows), -1))
        delta = part if delta is None else delta.unionByName(part)
    first = DAYS not in at.tables
    if delta is None and not first:
        return Work([])
    scratch = os.path.join(root, store.STAGED, f"resumen-{uuid.uuid4().hex[:12]}")
    if delta is not None:
        # many rows of a delivery fall on few days: grouped before they are written and dealt
        grouped = grouped_kept(delta)
        grouped.write.parquet(scratch)
        delta = spark.read.schema(grouped.schema).parquet(scratch)
    if first:
        base = None
        for name in CHILDREN:
            if name in at.tables:
                part = day_rows(name, store.read(spark, root, name, at))
                base = part if base is None else base.unionByName(part)
                reads[name] = None
        cells = None
    else:
        n_cells = at.tables[DAYS].n_cells
        cells = store.touched_cells(delta, [KEY], n_cells)
        base = store.read(spark, root, DAYS, at, cells)
    rows = delta if base is None else base if delta is None else base.unionByName(delta)
    if rows is None:
        return Work([])
    days = _written(grouped_days(rows), root, DAYS, at, cells, n_cells)
    now = Snapshot(0, {DAYS: days.table})
    patients = _written(patient_rows(store.read(spark, root, DAYS, now)), root, PATIENTS, at, cells, n_cells)
    if delta is not None:
        fs, p, _ = store._fs(spark, scratch)
        fs.delete(p, True)
    return Work([days, patients], reads)


def grouped_kept(rows: DataFrame) -> DataFrame:
    """As :func:`grouped_days`, but days whose counts cancel out stay: their sums may not."""
    return rows.groupBy(KEY, "clase", "fecha").agg(*_added_up()).select(KEY, "clase", "fecha", *COUNTS, *SUMS, *LARGE)


def _written(df: DataFrame, root: str, name: str, at: Snapshot, cells: set[int] | None, n_cells: int) -> Change:
    if cells is None:
        return store.replace(df, root, name, (KEY,), n_cells)
    _, new = store.write_cells(df, root, name, (KEY,), n_cells)
    # cells whose last day went are empty now
    gone = {c: ("", 0) for c in cells if c not in new}
    return Change(name, store.Table((KEY,), n_cells, at.tables[name].schema, {**new, **gone}))


def rebuilt(spark: SparkSession, root: str, tables: dict[str, DataFrame], n_cells: int) -> list[Change]:
    """Both summaries from whole tables (for a job that replaces these)."""
    rows = day_rows("consulta", tables["consulta"]).unionByName(day_rows("laboratorio", tables["laboratorio"]))
    days = store.replace(grouped_days(rows), root, DAYS, (KEY,), n_cells)
    again = store.read(spark, root, DAYS, Snapshot(0, {DAYS: days.table}))
    return [days, store.replace(patient_rows(again), root, PATIENTS, (KEY,), n_cells)]


def read_summaries(spark: SparkSession, root: str, at: Snapshot | None = None) -> tuple[DataFrame, DataFrame]:
    """``resumen`` and ``resumen_dia`` of a version (the newest by default)."""
    at = at or store.latest(spark, root)
    if PATIENTS not in at.tables:
        raise FileNotFoundError(f"{root}: no summaries are kept; deliver with summaries=True")
    return store.read(spark, root, PATIENTS, at), store.read(spark, root, DAYS, at)


def rollup_of(resumen: DataFrame, dias: DataFrame | None = None, as_of: date | str | None = None, months: int | None = None) -> DataFrame:
    """The summaries in the form of :func:`cohorte.operators.rollup.patient_rollup`, for Q2-Q4."""
    mean = lambda m: ((F.col(f"suma_{m}").cast("double") + F.col(f"grande_{m}")) / F.nullif(F.col(f"n_{m}"), F.lit(0))).alias(m)
    out = resumen.select(
        KEY,
        "count_consultas",
        F.col("count_consultas").alias("n_visit_rows"),
        "ultima_consulta",
        "primera_consulta",
        "count_laboratorios",
        F.col("count_laboratorios").alias("n_lab_rows"),
        "primera_fecha_lab",
        *[mean(m) for m in MEASURES],
    )
    if months is None:
        return out
    since = months_back(as_of, months)
    recent = dias.where((F.col("clase") == "consulta") & (F.col("fecha") >= since)).groupBy(KEY).agg(F.sum("filas").alias("consultas_recientes"))
    return out.join(recent, KEY, "left").withColumn("consultas_recientes", F.coalesce("consultas_recientes", F.lit(0)))
