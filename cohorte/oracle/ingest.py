"""Oracle SQL for the ingest queries (Q6, I1-I11): validity by NOT NULL
and foreign key, two overlapping deliveries, last delivery wins."""

from __future__ import annotations

import re

from cohorte.oracle import FIXTURE_CTES, SQL, core, with_fixtures
from cohorte.schemas import TABLES

CUT1 = "DATE '1998-01-01'"
CUT2 = "DATE '1997-07-01'"
DATE_COL = {"consulta": "fecha_consulta", "laboratorio": "fecha_muestra"}


def _missing_reasons(table: str, alias: str = "") -> str:
    spec = TABLES[table]
    pre = f"{alias}." if alias else ""
    parts = [f"CASE WHEN {pre}{c} IS NULL THEN '{c}: valor requerido ausente' END" for c in spec.required]
    return f"concat_ws('; ', {', '.join(parts)})"


def _all_present(table: str, alias: str = "") -> str:
    pre = f"{alias}." if alias else ""
    return " AND ".join(f"{pre}{c} IS NOT NULL" for c in TABLES[table].required)


CTES = f"""
vp AS (SELECT * FROM paciente WHERE {_all_present('paciente')}),
vc AS (SELECT * FROM consulta WHERE {_all_present('consulta')} AND id_paciente IN (SELECT id_paciente FROM vp)),
vl AS (SELECT * FROM laboratorio WHERE {_all_present('laboratorio')} AND id_paciente IN (SELECT id_paciente FROM vp))"""


def final_table(table: str) -> str:
    v = {"paciente": "vp", "consulta": "vc", "laboratorio": "vl"}[table]
    return with_fixtures(f"SELECT * FROM {v}", CTES)


def stats() -> str:
    parts = [
        "SELECT 'paciente' AS tabla, CAST(0 AS BIGINT) AS insertados, (SELECT COUNT(*) FROM vp) AS actualizados, "
        "(SELECT COUNT(*) FROM paciente) - (SELECT COUNT(*) FROM vp) AS errores"
    ]
    for t, v in (("consulta", "vc"), ("laboratorio", "vl")):
        key, d = TABLES[t].key, DATE_COL[t]
        v1 = f"(SELECT {key} FROM {v} WHERE {d} < {CUT1})"
        parts.append(
            f"SELECT '{t}', COUNT(*) FILTER (WHERE {key} NOT IN {v1}), COUNT(*) FILTER (WHERE {key} IN {v1}), "
            f"(SELECT COUNT(*) FROM {t} WHERE {d} >= {CUT2}) - COUNT(*) FROM {v} WHERE {d} >= {CUT2}"
        )
    return with_fixtures(" UNION ALL ".join(parts), CTES)


def quarantine() -> str:
    parts = [
        f"SELECT 'paciente' AS tabla, id_paciente AS clave, 'Error en paciente ' || id_paciente || ': ' || {_missing_reasons('paciente')} AS mensaje "
        f"FROM paciente WHERE NOT ({_all_present('paciente')})"
    ]
    for t in ("consulta", "laboratorio"):
        key, d = TABLES[t].key, DATE_COL[t]
        parts.append(
            f"SELECT '{t}', {key}, 'Error en {t} ' || {key} || ': ' || {_missing_reasons(t)} FROM {t} "
            f"WHERE {d} >= {CUT2} AND NOT ({_all_present(t)})"
        )
        parts.append(
            f"SELECT '{t}', {key}, 'Error en {t} ' || {key} || ': id_paciente: paciente inexistente (' || id_paciente || ')' FROM {t} "
            f"WHERE {d} >= {CUT2} AND {_all_present(t)} AND id_paciente NOT IN (SELECT id_paciente FROM vp)"
        )
    return with_fixtures(" UNION ALL ".join(parts), CTES)


def parse_consulta() -> str:
    return with_fixtures(f"SELECT *, {_missing_reasons('consulta')} AS motivos FROM consulta")


def pk_duplicates() -> str:
    parts = []
    for t in ("consulta", "laboratorio"):
        key, d = TABLES[t].key, DATE_COL[t]
        parts.append(
            f"SELECT '{t}' AS tabla, {key} AS clave, COUNT(*) AS copias FROM "
            f"(SELECT {key} FROM {t} WHERE {d} < {CUT1} UNION ALL SELECT {key} FROM {t} WHERE {d} >= {CUT2}) "
            f"GROUP BY {key} HAVING COUNT(*) > 1"
        )
    return with_fixtures(" UNION ALL ".join(parts))


def fk_orphans() -> str:
    parts = []
    for t in ("consulta", "laboratorio"):
        key = TABLES[t].key
        parts.append(
            f"SELECT '{t}' AS tabla, {key} AS clave, id_paciente FROM {t} "
            f"WHERE {_all_present(t)} AND id_paciente NOT IN (SELECT id_paciente FROM vp)"
        )
    return with_fixtures(" UNION ALL ".join(parts), CTES)


def over_ingested(sql: str) -> str:
    """A query of the clinical tables, over the rows of them that ingest keeps."""
    out = sql
    for t, v in (("paciente", "vp"), ("consulta", "vc"), ("laboratorio", "vl")):
        head, tail = out[: len(_HEAD)], out[len(_HEAD) :]
        out = head + re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {v}", tail)
    return out.replace(_HEAD, _HEAD + "," + CTES, 1)


_HEAD = "WITH " + FIXTURE_CTES

# day-first and month-first tell apart where the day is beyond the 12th
INFERRED_FORMATS = with_fixtures(
    """
SELECT campo, estado, formatos, celdas, legibles, indecisas FROM (
  SELECT 'dia_primero' AS campo, 'unico' AS estado, 'dd/MM/yyyy' AS formatos, count(*) AS celdas, count(*) AS legibles, 0 AS indecisas FROM consulta
  UNION ALL SELECT 'mes_primero', 'unico', 'MM/dd/yyyy', count(*), count(*), 0 FROM consulta
  UNION ALL SELECT 'mezclado', 'mezclado', 'dd/MM/yyyy|MM/dd/yyyy', count(*), count_if(d > 12 OR d = m), count_if(d <= 12 AND d <> m) FROM partes
  UNION ALL SELECT 'ambiguo', 'ambiguo', 'dd-MM-yyyy', count(*), count(*), 0 FROM consulta
  UNION ALL SELECT 'ilegible', 'ilegible', 'yyyyMMdd', count_if(id_consulta NOT LIKE '%2'), count_if(id_consulta NOT LIKE '%1' AND id_consulta NOT LIKE '%2'), 0 FROM consulta
  UNION ALL SELECT 'varios', 'varios', 'yyyy/MM/dd dd.MM.yyyy', count(*), count(*), 0 FROM consulta
)""",
    "partes AS (SELECT *, day(fecha_consulta) AS d, month(fecha_consulta) AS m FROM consulta)",
)
INFERRED_DATES = with_fixtures(
    """
SELECT id_consulta, fecha_consulta AS dia_primero, fecha_consulta AS mes_primero,
       CASE WHEN day(fecha_consulta) > 12 OR day(fecha_consulta) = month(fecha_consulta) THEN fecha_consulta END AS mezclado,
       date_trunc('month', fecha_consulta)::DATE AS ambiguo,
       CASE WHEN id_consulta NOT LIKE '%1' AND id_consulta NOT LIKE '%2' THEN fecha_consulta END AS ilegible, fecha_consulta AS varios
FROM consulta"""
)

SQL.update(
    {
        "q6_ingest_paciente": final_table("paciente"),
        "q6_ingest_consulta": final_table("consulta"),
        "q6_ingest_laboratorio": final_table("laboratorio"),
        "q6_ingest_stats": stats(),
        "i6_quarantine": quarantine(),
        "i1_parse_consulta": parse_consulta(),
        "i1_inferred_formats": INFERRED_FORMATS,
        "i1_inferred_dates": INFERRED_DATES,
        "i8_pk_duplicates": pk_duplicates(),
        "i9_fk_orphans": fk_orphans(),
        # the summaries follow the deliveries step by step; they add results up as decimals
        "q1_summary_gap": over_ingested(core.Q1_LAB_DX_GAP),
        "q2_summary_inactive": over_ingested(core.Q2_INACTIVE),
        "q3_summary_dashboard": over_ingested(core.Q3_DASHBOARD),
        "q4_summary_features": over_ingested(core.Q4_EXACT),
        # T1 streams the same two deliveries; the table must equal Q6's
        "t1_stream_ingest_consulta": final_table("consulta"),
        "t1_stream_ingest_laboratorio": final_table("laboratorio"),
    }
)
