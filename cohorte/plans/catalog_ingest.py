"""Registered ingest queries (Q6, I1-I11) over two deliveries of the whole
fixture tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.functions.dates import infer_formats, parsed_dates, report
from cohorte.operators.quality import REASONS, fk_orphans, parse_sheet, pk_duplicates, split_valid
from cohorte.plans import queries as Q
from cohorte.plans.ingest import ORDER, Delivery, deliver
from cohorte.plans.registry import register
from cohorte.plans.summaries import read_summaries, rollup_of
from cohorte.schemas import TABLES
from cohorte.session import scratch_path
from cohorte.sources.fixtures import AS_OF, clinical_tables, raw_deliveries, raw_sheets
from cohorte.sources.tables import read_latest

#: Cells of the fixture's tables, which are small.
CELLS = 8


def two_deliveries(spark: SparkSession, sf_dir: str, summaries: bool | None = None) -> tuple[str, Delivery]:
    """Both deliveries into a fresh store in the shared checkpoint folder."""
    root = scratch_path(spark, f"ingest-{uuid.uuid4().hex[:12]}")
    d1, d2 = raw_deliveries(spark, sf_dir)
    deliver(spark, root, d1, n_cells=CELLS, summaries=summaries)
    return root, deliver(spark, root, d2, n_cells=CELLS)


def _final(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_latest(spark, two_deliveries(spark, sf_dir)[0], name)

    return run


for _n in ORDER:
    register(f"q6_ingest_{_n}")(_final(_n))


@register("q6_ingest_stats")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_deliveries(spark, sf_dir)[1].stats_rows()


@register("i6_quarantine")
def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_deliveries(spark, sf_dir)[1].errors()


def _summarised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patients and both summaries, rolled up delivery by delivery."""
    root, _ = two_deliveries(spark, sf_dir, summaries=True)
    resumen, dias = read_summaries(spark, root)
    return read_latest(spark, root, "paciente"), resumen, dias


@register("q1_summary_gap")
def _q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, resumen, _ = _summarised(spark, sf_dir)
    return Q.gap_of(p, resumen.where("primera_fecha_lab IS NOT NULL").select("id_paciente", "primera_fecha_lab"))


@register("q2_summary_inactive")
def _q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, resumen, _ = _summarised(spark, sf_dir)
    return Q.inactive_of(p, resumen.select("id_paciente", "ultima_consulta", F.col("count_consultas").alias("total_consultas")), AS_OF, 90)


@register("q3_summary_dashboard")
def _q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, resumen, dias = _summarised(spark, sf_dir)
    return Q.dashboard_of(p, rollup_of(resumen, dias, AS_OF, 6))


@register("q4_summary_features")
def _q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, resumen, _ = _summarised(spark, sf_dir)
    return Q.features_of(p, rollup_of(resumen), AS_OF)


@register("i1_parse_consulta")
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_sheets(spark, sf_dir)["consulta"]
    parsed = parse_sheet(raw, TABLES["consulta"])
    return parsed.select(*TABLES["consulta"].columns, F.array_join(REASONS, "; ").alias("motivos"))


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's dates as sheets of different writers would have them, one column each."""
    t = clinical_tables(spark, sf_dir)
    d, month_first = "fecha_consulta", "date_format(fecha_consulta, 'MM/dd/yyyy')"
    return t["consulta"].selectExpr(
        "id_consulta",
        f"date_format({d}, 'dd/MM/yyyy') AS dia_primero",
        f"{month_first} AS mes_primero",
        f"CASE WHEN id_consulta LIKE '%7' THEN {month_first} ELSE date_format({d}, 'dd/MM/yyyy') END AS mezclado",
        f"date_format(trunc({d}, 'MM'), 'dd-MM-yyyy') AS ambiguo",
        f"CASE WHEN id_consulta LIKE '%1' THEN 'ayer' WHEN id_consulta LIKE '%2' THEN NULL ELSE date_format({d}, 'yyyyMMdd') END AS ilegible",
        f"CASE WHEN id_consulta LIKE '%3' THEN date_format({d}, 'yyyy/MM/dd') ELSE date_format({d}, 'dd.MM.yyyy') END AS varios",
    )


WRITTEN = ["dia_primero", "mes_primero", "mezclado", "ambiguo", "ilegible", "varios"]


@register("i1_inferred_formats")
def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infer_formats(written_dates(spark, sf_dir), WRITTEN)
    return report(spark, found).withColumn("formatos", F.array_join("formatos", " "))


@register("i1_inferred_dates")
def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = written_dates(spark, sf_dir)
    return parsed_dates(raw, infer_formats(raw, WRITTEN))


@register("i8_pk_duplicates")
def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d1, d2 = raw_deliveries(spark, sf_dir)
    out = None
    for name in ("consulta", "laboratorio"):
        key = TABLES[name].key
        both = d1[name].select(key).unionByName(d2[name].select(key))
        part = pk_duplicates(both, key).select(F.lit(name).alias("tabla"), F.col(key).alias("clave"), "copias")
        out = part if out is None else out.unionByName(part)
    return out


@register("i9_fk_orphans")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_sheets(spark, sf_dir)
    patients, _ = split_valid(parse_sheet(raw["paciente"], TABLES["paciente"]), TABLES["paciente"])
    out = None
    for name in ("consulta", "laboratorio"):
        spec = TABLES[name]
        good, _ = split_valid(parse_sheet(raw[name], spec), spec)
        part = fk_orphans(good, patients, "id_paciente").select(
            F.lit(name).alias("tabla"), F.col(spec.key).alias("clave"), "id_paciente"
        )
        out = part if out is None else out.unionByName(part)
    return out
