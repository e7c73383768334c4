"""Independent SQL formulations (DuckDB dialect) of the registered queries.

They state each question from its definition (per-patient summaries of the
child tables, Q3's average with its weight written out), over the same fixture
mapping, so a match checks both the mapping and the Spark plan.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"

# FIXTURES.md section 3 as DuckDB views.
FIXTURE_CTES = f"""
paciente AS (
  SELECT 'P' || CAST(c_custkey AS VARCHAR) AS id_paciente,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE ' m ' END AS sexo,
         CAST(CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE 18 + c_custkey % 73 END AS INTEGER) AS edad,
         CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'rural' ELSE 'URBANA ' END AS zona_residencia,
         DATE '1996-01-01' + CAST(c_custkey % 900 AS INTEGER) AS fecha_dx,
         c_mktsegment AS tipo_cancer,
         CASE c_custkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'II' WHEN 2 THEN 'Iii' ELSE ' iv' END AS estadio,
         CASE WHEN c_custkey % 23 = 0 THEN NULL
              ELSE CASE c_nationkey % 3 WHEN 0 THEN 'contributivo' WHEN 1 THEN 'SUBSIDIADO' ELSE 'Especial' END
         END AS aseguradora,
         c_acctbal > 2000 AS adherencia_12m
  FROM customer
),
consulta AS (
  SELECT 'C' || CAST(o_orderkey AS VARCHAR) AS id_consulta,
         CAST(o_orderdate AS DATE) AS fecha_consulta,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS motivo,
         o_orderpriority AS prioridad,
         'E' || CAST(o_orderkey % 7 AS VARCHAR) AS especialista,
         CASE WHEN o_custkey % 10 = 3 THEN 'P-' ELSE 'P' END || CAST(o_custkey AS VARCHAR) AS id_paciente
  FROM orders
),
laboratorio AS (
  SELECT 'L' || CAST(event_id AS VARCHAR) AS id_lab,
         DATE '1996-01-01' + CAST((event_id * 7) % 1500 AS INTEGER) AS fecha_muestra,
         CASE event_type WHEN 'signup' THEN 'Biopsia' WHEN 'view' THEN 'VPH' WHEN 'click' THEN 'Marcador CA125'
                         WHEN 'purchase' THEN 'PSA' WHEN 'error' THEN 'Colonoscopia' END AS tipo_prueba,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS resultado,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE value * 10 END AS resultado_numerico,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'ng/ml' END AS unidad,
         'P' || CAST(user_id AS VARCHAR) AS id_paciente
  FROM events
)"""


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    ctes = FIXTURE_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"



SQL: dict[str, str] = {}


def load_all() -> dict[str, str]:
    """Import every oracle module so its entries are in ``SQL``."""
    import importlib

    for mod in ("core", "ingest", "clean", "ml", "kpis"):
        try:
            importlib.import_module(f"cohorte.oracle.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"cohorte.oracle.{mod}":
                raise
    return SQL
