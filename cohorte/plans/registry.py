"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every entry reads the whole driver tables through the fixture adapter, so
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohorte.plans import queries as Q
from cohorte.sources.fixtures import AS_OF, clinical_tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


@register("q1_lab_dx_gap")
def _q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    return Q.lab_dx_gap(t["paciente"], t["laboratorio"])


@register("q2_inactive_patients")
def _q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    return Q.inactive_patients(t["paciente"], t["consulta"], as_of=AS_OF, days=90)


@register("q3_dashboard_by_type")
def _q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    return Q.dashboard_by_type(t["paciente"], t["consulta"], t["laboratorio"], as_of=AS_OF, months=6)


@register("q4_feature_table")
def _q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    return Q.feature_table(t["paciente"], t["consulta"], t["laboratorio"], as_of=AS_OF)


def load_all() -> dict[str, Query]:
    """Import every plan module so its ``@register`` entries exist."""
    import importlib

    for mod in (
        "cohorte.plans.catalog_ingest",
        "cohorte.plans.catalog_clean",
        "cohorte.plans.catalog_ml",
        "cohorte.plans.catalog_kpis",
        "cohorte.plans.catalog_stream",
    ):
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != mod:
                raise
    return dict(REGISTRY)
