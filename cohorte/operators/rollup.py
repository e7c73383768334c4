"""Per-patient roll-ups of the child tables.

Every business query joins a patient to *aggregates* of its visits and
labs. Aggregating each child by ``id_paciente`` before the join is what
makes the plans scale:

* the child rows are combined map-side (partial aggregate) before the
  shuffle, so a patient with a third of all rows costs one partial row per
  input split, not a hot reducer;
* the join then sees one row per patient on the child side, so there is no
  fan-out (visits x labs) and no skewed join key;
* visits and labs are rolled up in *one* aggregate over their union, so the
  two child tables share one exchange instead of two shuffles and a second
  join.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.functions.labels import months_back
from cohorte.functions.numeric import nan_to_null
from cohorte.functions.text import contains_any

KEY = "id_paciente"

# Lab-test buckets of the feature table (P6/A8) as
# (output column, lower-case LIKE patterns). Buckets may overlap.
TEST_BUCKETS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("avg_biopsia", ("biopsia",)),
    ("avg_vph", ("vph",)),
    ("avg_marcador_ca125", ("ca125", "marcador")),
    ("avg_psa", ("psa",)),
    ("avg_colonoscopia", ("colonoscopia",)),
)


def _visit_aggs(fecha: Column, vid: Column, is_visit: Column, since: Column | None) -> list[Column]:
    aggs = [
        F.count(vid).alias("count_consultas"),
        F.count_if(is_visit).alias("n_visit_rows"),
        F.max(fecha).alias("ultima_consulta"),
        F.min(fecha).alias("primera_consulta"),
    ]
    if since is not None:
        aggs.append(F.count_if(is_visit & (fecha >= since)).alias("consultas_recientes"))
    return aggs


def _lab_aggs(fecha: Column, lid: Column, is_lab: Column, tipo: Column, value: Column, buckets) -> list[Column]:
    aggs = [
        F.count(lid).alias("count_laboratorios"),
        F.count_if(is_lab).alias("n_lab_rows"),
        F.min(fecha).alias("primera_fecha_lab"),
        F.avg(value).alias("avg_resultado_numerico"),
    ]
    for name, patterns in buckets:
        aggs.append(F.avg(F.when(contains_any(tipo, patterns), value)).alias(name))
    return aggs


def visit_rollup(consulta: DataFrame, as_of: date | str | None = None, months: int | None = None) -> DataFrame:
    """One row per patient with visits: counts, first/last visit date and,
    when ``months`` is given, the visits on or after ``as_of - months``."""
    since = months_back(as_of, months) if months is not None else None
    return consulta.groupBy(KEY).agg(
        *_visit_aggs(F.col("fecha_consulta"), F.col("id_consulta"), F.lit(True), since)
    )


def lab_rollup(laboratorio: DataFrame, buckets=TEST_BUCKETS) -> DataFrame:
    """One row per patient with labs: counts, first sample date, the mean
    numeric result overall and per test bucket (NaN ignored)."""
    return laboratorio.groupBy(KEY).agg(
        *_lab_aggs(
            F.col("fecha_muestra"),
            F.col("id_lab"),
            F.lit(True),
            F.col("tipo_prueba"),
            nan_to_null("resultado_numerico"),
            buckets,
        )
    )


def patient_rollup(
    consulta: DataFrame,
    laboratorio: DataFrame,
    as_of: date | str | None = None,
    months: int | None = None,
    buckets=TEST_BUCKETS,
) -> DataFrame:
    """Visits and labs rolled up together: union of the two projected child
    tables, then a single ``groupBy(id_paciente)`` (one exchange)."""
    v = consulta.select(
        F.col(KEY),
        F.lit(True).alias("_is_visit"),
        F.col("id_consulta").alias("_vid"),
        F.col("fecha_consulta").alias("_vdate"),
        F.lit(None).cast("string").alias("_lid"),
        F.lit(None).cast("date").alias("_ldate"),
        F.lit(None).cast("string").alias("_tipo"),
        F.lit(None).cast("double").alias("_value"),
    )
    lab = laboratorio.select(
        F.col(KEY),
        F.lit(False).alias("_is_visit"),
        F.lit(None).cast("string").alias("_vid"),
        F.lit(None).cast("date").alias("_vdate"),
        F.col("id_lab").alias("_lid"),
        F.col("fecha_muestra").alias("_ldate"),
        F.col("tipo_prueba").alias("_tipo"),
        nan_to_null("resultado_numerico").alias("_value"),
    )
    since = months_back(as_of, months) if months is not None else None
    is_visit = F.col("_is_visit")
    return v.unionByName(lab).groupBy(KEY).agg(
        *_visit_aggs(F.col("_vdate"), F.col("_vid"), is_visit, since),
        *_lab_aggs(F.col("_ldate"), F.col("_lid"), ~is_visit, F.col("_tipo"), F.col("_value"), buckets),
    )
