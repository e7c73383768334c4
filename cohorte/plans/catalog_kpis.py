"""Registered second-tier analytics (X1-X21) over the whole fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.operators.split import train_test
from cohorte.operators.variants import variant_map
from cohorte.plans import kpis as K
from cohorte.plans.catalog_ml import feature_table, trained, written_rule_log
from cohorte.plans.registry import register
from cohorte.plans.training import KEY, prepare, score
from cohorte.schemas import NUMERIC_FEATURES
from cohorte.sources.fixtures import AS_OF, clinical_tables
from cohorte.sources.logs import read_log

SALT = "cohorte-demo-salt"


def _t(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return clinical_tables(spark, sf_dir)


@register("x1_cancer_type_detail")
def _x1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.cancer_type_detail(t["paciente"], t["consulta"], t["laboratorio"])


@register("x1_stage_insurer_split")
def _x1s(spark, sf_dir):
    return K.split_by(_t(spark, sf_dir)["paciente"], "tipo_cancer", ("estadio", "aseguradora"))


@register("x2_recently_active")
def _x2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.recently_active(t["paciente"], t["consulta"], t["laboratorio"], AS_OF, days=90)


@register("x3_patient_lab_analysis")
def _x3(spark, sf_dir):
    return K.patient_lab_analysis(_t(spark, sf_dir)["laboratorio"])


@register("x5_patients_by_type")
def _x5a(spark, sf_dir):
    return K.patients_by_type(_t(spark, sf_dir)["paciente"])


@register("x5_visits_by_month")
def _x5b(spark, sf_dir):
    return K.visits_by_month(_t(spark, sf_dir)["consulta"])


@register("x6_adherence_by_group")
def _x6(spark, sf_dir):
    p = _t(spark, sf_dir)["paciente"].withColumn("_todos", F.lit("todos"))
    return K.split_by(p, "_todos", ("sexo", "zona_residencia", "aseguradora")).drop("_todos")


@register("x7_lab_means_by_month")
def _x7(spark, sf_dir):
    return K.lab_means_by_month(_t(spark, sf_dir)["laboratorio"])


@register("x9_adherence_goal")
def _x9(spark, sf_dir):
    return K.adherence_goal(_t(spark, sf_dir)["paciente"])


@register("x10_early_stage_share")
def _x10(spark, sf_dir):
    return K.early_stage_share(_t(spark, sf_dir)["paciente"])


@register("x11_time_to_treatment")
def _x11(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.time_to_treatment(t["paciente"], t["consulta"])


@register("x11_visits_with_last_lab")
def _x11l(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.visits_with_last_lab(t["consulta"], t["laboratorio"], within_days=365)


@register("x12_visits_by_specialist")
def _x12(spark, sf_dir):
    return K.visits_by_specialist(_t(spark, sf_dir)["consulta"])


@register("x13_abandonment")
def _x13(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.abandonment(t["paciente"], t["consulta"])


@register("x14_service_use")
def _x14(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.service_use(t["consulta"], t["laboratorio"])


@register("x15_usage_clusters")
def _x15(spark, sf_dir):
    return K.usage_clusters(feature_table(spark, sf_dir))


@register("x17_feature_drift")
def _x17(spark, sf_dir):
    train_df, test_df = train_test(prepare(feature_table(spark, sf_dir)), KEY, 0.2, 42)
    return K.population_stability(train_df, test_df, NUMERIC_FEATURES)


@register("x17_drift_against_log")
def _x17l(spark, sf_dir):
    train_df, _ = train_test(prepare(feature_table(spark, sf_dir)), KEY, 0.2, 42)
    return K.drift_against_log(train_df, read_log(spark, written_rule_log(spark, sf_dir)))


@register("x18_served_versions")
def _x18(spark, sf_dir):
    """A training per cancer type and month of diagnosis, its metric the month's
    adherence rate: which version is served after each."""
    p = _t(spark, sf_dir)["paciente"].where("adherencia_12m IS NOT NULL")
    month = F.trunc("fecha_dx", "MM")
    runs = p.groupBy("tipo_cancer", month.alias("mes")).agg(F.avg(F.col("adherencia_12m").cast("double")).alias("m"))
    registry = runs.select(
        F.col("tipo_cancer").alias("model_type"), F.date_format("mes", "yyyyMM").alias("version"), F.col("mes").cast("timestamp").alias("trained_at"),
        F.create_map(F.lit("test_f1_score"), "m").alias("metrics"),
    )
    return K.served_versions(registry)


@register("x19_harmonisation_map")
def _x19(spark, sf_dir):
    return K.harmonisation_map(_t(spark, sf_dir)["paciente"], ["sexo", "zona_residencia", "estadio", "aseguradora", "tipo_cancer"])


@register("x19_harmonised_patients")
def _x19h(spark, sf_dir):
    return K.harmonised(_t(spark, sf_dir)["paciente"], ["sexo", "zona_residencia", "estadio", "aseguradora"]).select(
        "id_paciente", "sexo", "zona_residencia", "estadio", "aseguradora"
    )


VARIANT_COLUMNS = ["sexo", "zona_residencia", "estadio", "aseguradora"]


def spelled_patients(spark, sf_dir):
    """The fixture's patients as typed by many hands: abbreviations and typing errors by residues of the key."""
    k = "CAST(substr(id_paciente, 2) AS BIGINT)"
    return _t(spark, sf_dir)["paciente"].selectExpr(
        "id_paciente",
        f"CASE WHEN {k} % 3 = 0 THEN CASE sexo WHEN 'F' THEN 'Femenino' ELSE 'MASCULINO' END WHEN {k} % 41 = 1 THEN 'femenimo' WHEN {k} % 43 = 1 THEN 'masc.' ELSE sexo END AS sexo",
        f"CASE WHEN {k} % 37 = 2 THEN 'urbna' WHEN {k} % 53 = 3 THEN 'Rurál ' ELSE zona_residencia END AS zona_residencia",
        "estadio",
        f"CASE WHEN {k} % 47 = 4 THEN 'Subsidiada' WHEN {k} % 59 = 5 THEN 'Contributvo' WHEN {k} % 61 = 6 THEN 'esp' ELSE aseguradora END AS aseguradora",
    )


@register("x19_variant_map")
def _x19v(spark, sf_dir):
    return variant_map(spelled_patients(spark, sf_dir), VARIANT_COLUMNS)


@register("x19_unified_patients")
def _x19u(spark, sf_dir):
    return K.harmonised(spelled_patients(spark, sf_dir), VARIANT_COLUMNS, variants=True)


@register("x20_rule_quality")
def _x20r(spark, sf_dir):
    """X20 with the rule score (visits / (visits + 10)) instead of a model."""
    f = feature_table(spark, sf_dir)
    p = F.col("count_consultas") / (F.col("count_consultas") + F.lit(10.0))
    return K.live_quality(f.select(KEY, (p > 0.5).cast("int").alias("prediccion")), f)


@register("x20_live_quality")
def _x20(spark, sf_dir):
    res = trained(spark, sf_dir, "xgboost")
    f = feature_table(spark, sf_dir)
    scored = score(res.model, prepare(f))
    return K.live_quality(scored, f)


@register("x21_anonymised_patients")
def _x21(spark, sf_dir):
    return K.anonymise(_t(spark, sf_dir)["paciente"], SALT)
