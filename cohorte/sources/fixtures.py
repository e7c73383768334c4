"""Adapter: the driver's generated tables presented as the clinical tables.

The mapping is the one written down in FIXTURES.md section 3. It is a pure
projection of whole tables (no sampling, no id subsets): every customer is a
patient, every order is a visit (those of customers whose key ends in 3 name a
patient that does not exist, so there are patients without visits and visits
without a patient), every event is a lab result. The views are deliberately dirtier than the DDL
(stray spaces, mixed case, NULLs in NOT NULL columns) so cleaning and
quarantine have work to do.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (FIXTURES.md section 3).
AS_OF = date(2001, 8, 1)
EPOCH = "1996-01-01"
ESTADIO_BY_MOD4 = ["i", "II", "Iii", " iv"]
ASEGURADORA_BY_NATION_MOD3 = ["contributivo", "SUBSIDIADO", "Especial"]
TIPO_PRUEBA_BY_EVENT = {
    "signup": "Biopsia",
    "view": "VPH",
    "click": "Marcador CA125",
    "purchase": "PSA",
    "error": "Colonoscopia",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick_sql(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _epoch_plus_sql(days: str) -> str:
    return f"date_add(DATE'{EPOCH}', CAST({days} AS INT))"


# The projections are SQL expression text: one call to the JVM per
# projection instead of one per expression node.
def paciente_from_customer(customer: DataFrame) -> DataFrame:
    k = "c_custkey"
    return customer.selectExpr(
        f"concat('P', CAST({k} AS STRING)) AS id_paciente",
        f"CASE WHEN {k} % 2 = 0 THEN 'F' ELSE ' m ' END AS sexo",
        f"CAST(CASE WHEN {k} % 11 = 5 THEN NULL ELSE 18 + {k} % 73 END AS INT) AS edad",
        f"CASE WHEN {k} % 17 = 0 THEN NULL WHEN {k} % 5 = 0 THEN 'rural' ELSE 'URBANA ' END AS zona_residencia",
        f"{_epoch_plus_sql(f'{k} % 900')} AS fecha_dx",
        "c_mktsegment AS tipo_cancer",
        f"{_pick_sql(f'{k} % 4', ESTADIO_BY_MOD4)} AS estadio",
        f"CASE WHEN {k} % 23 = 0 THEN NULL ELSE {_pick_sql('c_nationkey % 3', ASEGURADORA_BY_NATION_MOD3)} END AS aseguradora",
        "c_acctbal > 2000 AS adherencia_12m",
    )


def consulta_from_orders(orders: DataFrame) -> DataFrame:
    k = "o_orderkey"
    return orders.selectExpr(
        f"concat('C', CAST({k} AS STRING)) AS id_consulta",
        "CAST(o_orderdate AS DATE) AS fecha_consulta",
        f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE o_orderstatus END AS motivo",
        "o_orderpriority AS prioridad",
        f"concat('E', CAST({k} % 7 AS STRING)) AS especialista",
        "concat(CASE WHEN o_custkey % 10 = 3 THEN 'P-' ELSE 'P' END, CAST(o_custkey AS STRING)) AS id_paciente",
    )


def laboratorio_from_events(events: DataFrame) -> DataFrame:
    k = "event_id"
    arms = " ".join(f"WHEN '{ev}' THEN '{name}'" for ev, name in TIPO_PRUEBA_BY_EVENT.items())
    return events.selectExpr(
        f"concat('L', CAST({k} AS STRING)) AS id_lab",
        f"{_epoch_plus_sql(f'({k} * 7) % 1500')} AS fecha_muestra",
        f"CASE event_type {arms} END AS tipo_prueba",
        f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE event_type END AS resultado",
        f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE value * 10 END AS resultado_numerico",
        f"CASE WHEN {k} % 10 = 0 THEN NULL ELSE 'ng/ml' END AS unidad",
        "concat('P', CAST(user_id AS STRING)) AS id_paciente",
    )


_PLANS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def clinical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three clinical tables over the driver's parquet files (lazy).

    The lazy plans are memoised per session and folder: building them is
    pure driver work, and a DataFrame is an immutable plan, so reusing it
    holds no data and changes no result."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _PLANS:
        _PLANS[key] = {
            "paciente": paciente_from_customer(read_table(spark, sf_dir, "customer")),
            "consulta": consulta_from_orders(read_table(spark, sf_dir, "orders")),
            "laboratorio": laboratorio_from_events(read_table(spark, sf_dir, "events")),
        }
    return dict(_PLANS[key])


# Fixed values of the two fixture deliveries used to exercise ingest: the
# first holds visits/labs dated before CUTOFF_1, the second those from
# CUTOFF_2 on (the overlap re-delivers rows, i.e. updates); both deliver
# every patient.
CUTOFF_1 = "1998-01-01"
CUTOFF_2 = "1997-07-01"


def raw_sheets(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The same tables as a text workbook would deliver them: every cell a
    string, dates as ``dd/MM/yyyy`` for visits (a second date format), the
    adherence flag as ``si``/``no``, plus ``_fila`` (row order in the sheet).
    Used to drive ingest (Q6)."""
    t = tables or clinical_tables(spark, sf_dir)
    p = t["paciente"].select(
        *[F.col(c).cast("string").alias(c) for c in t["paciente"].columns if c != "adherencia_12m"],
        F.when(F.col("adherencia_12m"), F.lit("si")).otherwise(F.lit("no")).alias("adherencia_12m"),
    )
    c = t["consulta"].select(
        *[
            (F.date_format("fecha_consulta", "dd/MM/yyyy") if n == "fecha_consulta" else F.col(n).cast("string")).alias(n)
            for n in t["consulta"].columns
        ]
    )
    l = t["laboratorio"].select(*[F.col(n).cast("string").alias(n) for n in t["laboratorio"].columns])
    out = {"paciente": p, "consulta": c, "laboratorio": l}
    keys = {"paciente": "id_paciente", "consulta": "id_consulta", "laboratorio": "id_lab"}
    return {n: df.withColumn("_fila", F.substring(keys[n], 2, 30).cast("long")) for n, df in out.items()}


def raw_deliveries(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two overlapping deliveries covering the whole tables (see CUTOFF_*)."""
    t = clinical_tables(spark, sf_dir)
    first = dict(t)
    first["consulta"] = t["consulta"].where(F.col("fecha_consulta") < F.lit(CUTOFF_1).cast("date"))
    first["laboratorio"] = t["laboratorio"].where(F.col("fecha_muestra") < F.lit(CUTOFF_1).cast("date"))
    second = dict(t)
    second["consulta"] = t["consulta"].where(F.col("fecha_consulta") >= F.lit(CUTOFF_2).cast("date"))
    second["laboratorio"] = t["laboratorio"].where(F.col("fecha_muestra") >= F.lit(CUTOFF_2).cast("date"))
    return raw_sheets(spark, sf_dir, first), raw_sheets(spark, sf_dir, second)
