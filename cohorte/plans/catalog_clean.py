"""Registered cleaning queries (Q5, C1-C13) over the whole fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.operators.clean import TextNormaliser, null_rates
from cohorte.plans.cleaning import clean_all, clean_table, combined_report, protected_columns, summary
from cohorte.plans.registry import register
from cohorte.sources.fixtures import clinical_tables

ORDER = ("paciente", "consulta", "laboratorio")


def _runs(spark: SparkSession, sf_dir: str):
    return clean_all(clinical_tables(spark, sf_dir))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("c1_normalise_paciente")
def _c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clinical_tables(spark, sf_dir)["paciente"]
    return TextNormaliser(exclude=protected_columns("paciente")).transform(p)


@register("c3_normalisation_report")
def _c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    frames = []
    for name in ORDER:
        rep = TextNormaliser(exclude=protected_columns(name)).report(t[name])
        frames.append(rep.select(F.lit(name).alias("tabla"), *rep.columns))
    return _union(frames)


@register("c3_normalisation_examples")
def _c3e(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    frames = []
    for name in ORDER:
        ex = TextNormaliser(exclude=protected_columns(name)).examples(t[name])
        frames.append(ex.select(F.lit(name).alias("tabla"), *ex.columns))
    return _union(frames)


@register("c4_null_rates")
def _c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    frames = []
    for name in ORDER:
        n = TextNormaliser(exclude=protected_columns(name)).transform(t[name])
        r = null_rates(n)
        frames.append(r.select(F.lit(name).alias("tabla"), *r.columns))
    return _union(frames)


@register("c5_imputation_values")
def _c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.fill_values() for r in _runs(spark, sf_dir).values()])


@register("c7_missing_report")
def _c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.missing_report() for r in _runs(spark, sf_dir).values()])


@register("c8_iqr_bounds")
def _c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.bounds() for r in _runs(spark, sf_dir).values()])


@register("c10_outlier_report")
def _c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.outlier_report() for r in _runs(spark, sf_dir).values()])


@register("c10_outlier_values")
def _c10v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.outlier_values() for r in _runs(spark, sf_dir).values()])


def _clean_one(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clean_table(clinical_tables(spark, sf_dir)[name], name).cleaned()

    return run


for _name in ORDER:
    register(f"q5_clean_{_name}")(_clean_one(_name))


@register("c12_combined_report")
def _c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined_report(_runs(spark, sf_dir))


@register("c13_summary")
def _c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_runs(spark, sf_dir))
