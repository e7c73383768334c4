"""The four analytical queries of the reference (Q1-Q4), Spark-first.

All take the three clinical tables as DataFrames and an explicit ``as_of``
date for anything relative to "today". Child tables are rolled up per
patient before the join (see :mod:`cohorte.operators.rollup`).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.functions.labels import (
    activity_label,
    as_of_lit,
    consistency_label,
    days_between,
)
from cohorte.functions.numeric import round_to, safe_avg_output
from cohorte.operators.rollup import (
    KEY,
    TEST_BUCKETS,
    lab_rollup,
    patient_rollup,
    visit_rollup,
)

PATIENT_COLUMNS = [
    "id_paciente",
    "sexo",
    "edad",
    "zona_residencia",
    "fecha_dx",
    "tipo_cancer",
    "estadio",
    "aseguradora",
    "adherencia_12m",
]


def lab_dx_gap(paciente: DataFrame, laboratorio: DataFrame, ordered: bool = True) -> DataFrame:
    """Q1: days between diagnosis and the first lab sample, with a
    consistency message (no lab / diagnosis dated before the first lab)."""
    return gap_of(paciente, laboratorio.groupBy(KEY).agg(F.min("fecha_muestra").alias("primera_fecha_lab")), ordered)


def gap_of(paciente: DataFrame, labs: DataFrame, ordered: bool = True) -> DataFrame:
    """Q1 from one row per patient with labs (``primera_fecha_lab``)."""
    gap = days_between("fecha_dx", "primera_fecha_lab")
    out = paciente.select(*PATIENT_COLUMNS).join(labs, KEY, "left").select(
        *PATIENT_COLUMNS,
        F.col("primera_fecha_lab"),
        gap.alias("dias_entre_lab_y_dx"),
        consistency_label(F.col("primera_fecha_lab"), gap).alias("mensaje_consistencia"),
    )
    return out.orderBy(KEY) if ordered else out


def inactive_patients(
    paciente: DataFrame,
    consulta: DataFrame,
    as_of: date | str | None = None,
    days: int = 90,
    ordered: bool = True,
) -> DataFrame:
    """Q2: patients whose last visit is more than ``days`` before ``as_of``,
    or who never had one; most idle first, never-visited on top."""
    visits = consulta.groupBy(KEY).agg(
        F.max("fecha_consulta").alias("ultima_consulta"),
        F.count("id_consulta").alias("total_consultas"),
    )
    return inactive_of(paciente, visits, as_of, days, ordered)


def inactive_of(paciente: DataFrame, visits: DataFrame, as_of: date | str | None = None, days: int = 90, ordered: bool = True) -> DataFrame:
    """Q2 from one row per patient with visits (``ultima_consulta, total_consultas``)."""
    idle = days_between(as_of_lit(as_of), "ultima_consulta")
    out = (
        paciente.select(*PATIENT_COLUMNS)
        .join(visits, KEY, "left")
        .select(
            *PATIENT_COLUMNS,
            F.col("ultima_consulta"),
            idle.alias("dias_sin_consulta"),
            F.coalesce(F.col("total_consultas"), F.lit(0)).alias("total_consultas"),
        )
        .where(F.col("ultima_consulta").isNull() | (F.col("dias_sin_consulta") > days))
        .withColumn("estado_actividad", activity_label("ultima_consulta", "dias_sin_consulta"))
    )
    if ordered:
        out = out.orderBy(F.col("dias_sin_consulta").desc_nulls_first(), F.col(KEY))
    return out


def dashboard_by_type(
    paciente: DataFrame,
    consulta: DataFrame,
    laboratorio: DataFrame,
    as_of: date | str | None = None,
    months: int = 6,
    ordered: bool = True,
) -> DataFrame:
    """Q3: per cancer type: patients, mean age, visits in the last
    ``months`` and lab count.

    The reference computes this over the visits x labs fan-out, so its mean
    age weighs each patient by ``max(v,1) * max(l,1)``. Here the children are
    rolled up first and the weight is applied explicitly, which gives the
    same numbers without materialising the fan-out. ``promedio_edad_paciente``
    is the plain per-patient mean.
    """
    return dashboard_of(paciente, patient_rollup(consulta, laboratorio, as_of=as_of, months=months), ordered)


def dashboard_of(paciente: DataFrame, r: DataFrame, ordered: bool = True) -> DataFrame:
    """Q3 from a roll-up per patient (with ``consultas_recientes``)."""
    j = paciente.select(KEY, "tipo_cancer", "edad").join(r, KEY, "left")
    w = F.greatest(F.coalesce("n_visit_rows", F.lit(0)), F.lit(1)) * F.greatest(
        F.coalesce("n_lab_rows", F.lit(0)), F.lit(1)
    )
    edad = F.col("edad")
    out = j.groupBy("tipo_cancer").agg(
        # ids are unique (primary key, enforced by ingest), so a plain count
        # equals the reference's COUNT(DISTINCT) without an Expand/extra shuffle
        F.count(KEY).alias("total_pacientes"),
        round_to(F.sum(edad * w) / F.sum(F.when(edad.isNotNull(), w))).alias("promedio_edad"),
        round_to(F.avg(edad)).alias("promedio_edad_paciente"),
        F.coalesce(F.sum("consultas_recientes"), F.lit(0)).alias("consultas_ultimos_6_meses"),
        F.coalesce(F.sum("count_laboratorios"), F.lit(0)).alias("total_laboratorios"),
    )
    if ordered:
        out = out.orderBy(F.col("total_pacientes").desc(), F.col("tipo_cancer"))
    return out


REQUIRED_FOR_FEATURES = ["sexo", "tipo_cancer", "estadio", "aseguradora"]


def feature_table(
    paciente: DataFrame,
    consulta: DataFrame,
    laboratorio: DataFrame,
    as_of: date | str | None = None,
    buckets=TEST_BUCKETS,
    keep_id: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Q4: one row per patient, 16 model columns (plus ``id_paciente``)."""
    return features_of(paciente, patient_rollup(consulta, laboratorio, as_of=as_of, buckets=buckets), as_of, buckets, keep_id, ordered)


def features_of(
    paciente: DataFrame, r: DataFrame, as_of: date | str | None = None, buckets=TEST_BUCKETS, keep_id: bool = True, ordered: bool = True
) -> DataFrame:
    """Q4 from a roll-up per patient."""
    p = paciente.dropna(subset=REQUIRED_FOR_FEATURES)
    cols = [
        F.col("sexo"),
        F.col("edad"),
        F.coalesce(F.col("zona_residencia"), F.lit("Desconocida")).alias("zona_residencia"),
        F.col("tipo_cancer"),
        F.col("estadio"),
        F.col("aseguradora"),
        F.coalesce(F.col("count_consultas"), F.lit(0)).alias("count_consultas"),
        days_between(as_of_lit(as_of), "fecha_dx").alias("dias_desde_diagnostico"),
        F.coalesce(F.col("count_laboratorios"), F.lit(0)).alias("count_laboratorios"),
        safe_avg_output("avg_resultado_numerico").alias("avg_resultado_numerico"),
        *[safe_avg_output(name).alias(name) for name, _ in buckets],
        F.when(F.col("adherencia_12m"), F.lit(1)).otherwise(F.lit(0)).alias("adherencia_12m"),
    ]
    if keep_id:
        cols = [F.col(KEY)] + cols
    out = p.join(r, KEY, "left").select(*cols)
    if ordered and keep_id:
        out = out.orderBy(KEY)
    return out


__all__ = [
    "lab_dx_gap",
    "inactive_patients",
    "dashboard_by_type",
    "feature_table",
    "lab_rollup",
    "visit_rollup",
]
