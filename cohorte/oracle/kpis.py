"""Oracle SQL for the second-tier analytics."""

from __future__ import annotations

from cohorte.oracle import AS_OF, SQL, with_fixtures
from cohorte.oracle.clean import norm
from cohorte.oracle.core import FEATURE_TABLE_CTES
from cohorte.schemas import NUMERIC_FEATURES

EARLY = f"CASE WHEN ({norm('estadio')}) IN ('I', 'Ii') THEN 1.0 ELSE 0.0 END"

X1 = with_fixtures(
    f"""
SELECT p.tipo_cancer, COUNT(*) AS pacientes,
       ROUND(AVG(CASE WHEN p.adherencia_12m THEN 1.0 ELSE 0.0 END), 4) AS tasa_adherencia,
       ROUND(AVG(p.edad), 2) AS edad_media,
       ROUND(AVG({EARLY.replace('estadio', 'p.estadio')}), 4) AS proporcion_etapa_temprana,
       ROUND(AVG(COALESCE(v.n, 0)), 4) AS consultas_por_paciente,
       ROUND(AVG(COALESCE(l.n, 0)), 4) AS laboratorios_por_paciente
FROM paciente p
LEFT JOIN (SELECT id_paciente, COUNT(*) AS n FROM consulta GROUP BY 1) v USING (id_paciente)
LEFT JOIN (SELECT id_paciente, COUNT(*) AS n FROM laboratorio GROUP BY 1) l USING (id_paciente)
GROUP BY p.tipo_cancer"""
)


def split_sql(by: str, dims: tuple[str, ...], keep_by: bool = True) -> str:
    parts = [
        f"SELECT {by} AS g, '{d}' AS dimension, CAST({d} AS VARCHAR) AS valor, CASE WHEN adherencia_12m THEN 1.0 ELSE 0.0 END AS a FROM paciente"
        for d in dims
    ]
    sel = f"g AS {by}, " if keep_by else ""
    return with_fixtures(
        f"SELECT {sel}dimension, valor, COUNT(*) AS pacientes, ROUND(AVG(a), 4) AS tasa_adherencia "
        f"FROM ({' UNION ALL '.join(parts)}) GROUP BY g, dimension, valor"
    )


X2 = with_fixtures(
    f"""
SELECT * FROM paciente WHERE id_paciente IN (
  SELECT id_paciente FROM consulta WHERE fecha_consulta >= {AS_OF} - INTERVAL 90 DAY
  UNION SELECT id_paciente FROM laboratorio WHERE fecha_muestra >= {AS_OF} - INTERVAL 90 DAY)"""
)

X3 = with_fixtures(
    """
SELECT id_paciente, tipo_prueba, COUNT(*) AS pruebas, ROUND(AVG(resultado_numerico), 4) AS promedio_resultado,
       MIN(fecha_muestra) AS primera, MAX(fecha_muestra) AS ultima
FROM laboratorio GROUP BY id_paciente, tipo_prueba"""
)

X5A = with_fixtures("SELECT tipo_cancer, COUNT(*) AS pacientes FROM paciente GROUP BY tipo_cancer")
X5B = with_fixtures(
    "SELECT CAST(date_trunc('month', fecha_consulta) AS DATE) AS mes, COUNT(*) AS consultas, COUNT(DISTINCT id_paciente) AS pacientes "
    "FROM consulta GROUP BY 1"
)
X7 = with_fixtures(
    "SELECT tipo_prueba, CAST(date_trunc('month', fecha_muestra) AS DATE) AS mes, COUNT(*) AS pruebas, "
    "ROUND(AVG(resultado_numerico), 4) AS promedio_resultado FROM laboratorio GROUP BY 1, 2"
)
X9 = with_fixtures(
    "SELECT COUNT(*) AS pacientes, ROUND(AVG(CASE WHEN adherencia_12m THEN 1.0 ELSE 0.0 END), 4) AS tasa_adherencia, "
    "0.8 AS meta, AVG(CASE WHEN adherencia_12m THEN 1.0 ELSE 0.0 END) >= 0.8 AS cumple_meta FROM paciente"
)
X10 = with_fixtures(f"SELECT COUNT(*) AS pacientes, ROUND(AVG({EARLY}), 4) AS proporcion_etapa_temprana FROM paciente")
X11 = with_fixtures(
    """
SELECT p.id_paciente, p.fecha_dx, f.primera_consulta,
       CAST(f.primera_consulta - p.fecha_dx AS INTEGER) AS dias_a_tratamiento,
       COALESCE(f.primera_consulta - p.fecha_dx < 30, FALSE) AS dentro_meta
FROM paciente p LEFT JOIN (
  SELECT c.id_paciente, MIN(c.fecha_consulta) AS primera_consulta
  FROM consulta c JOIN paciente p2 ON c.id_paciente = p2.id_paciente
  WHERE c.fecha_consulta >= p2.fecha_dx GROUP BY c.id_paciente) f ON f.id_paciente = p.id_paciente"""
)
# the last result before each visit, no more than a year old
X11_LAST_LAB = with_fixtures(
    """
SELECT c.id_consulta, c.id_paciente, c.fecha_consulta, CASE WHEN cerca THEN m.valor END AS ultimo_resultado, CASE WHEN cerca THEN m.dia END AS fecha_resultado,
       CASE WHEN cerca THEN date_diff('day', m.dia, c.fecha_consulta)::INTEGER END AS dias_desde_resultado
FROM consulta c ASOF LEFT JOIN dias m ON m.id_paciente = c.id_paciente AND m.dia <= c.fecha_consulta,
     LATERAL (SELECT date_diff('day', m.dia, c.fecha_consulta) <= 365 AS cerca)""",
    """
dias AS (SELECT id_paciente, fecha_muestra AS dia, min(resultado_numerico) AS valor FROM laboratorio WHERE resultado_numerico IS NOT NULL GROUP BY ALL)""",
)
X12 = with_fixtures(
    "SELECT especialista, COUNT(*) AS consultas, COUNT(DISTINCT id_paciente) AS pacientes FROM consulta GROUP BY especialista"
)
X13 = with_fixtures(
    """
SELECT p.id_paciente, p.fecha_dx, MAX(c.fecha_consulta) AS ultima_consulta,
       MAX(c.fecha_consulta) IS NULL OR MAX(c.fecha_consulta) < p.fecha_dx + INTERVAL 6 MONTH AS abandono
FROM paciente p LEFT JOIN consulta c ON c.id_paciente = p.id_paciente
GROUP BY p.id_paciente, p.fecha_dx"""
)
X14 = with_fixtures(
    """
SELECT id_paciente, fuente, categoria, COUNT(*) AS n FROM (
  SELECT id_paciente, 'motivo' AS fuente, COALESCE(motivo, '(sin dato)') AS categoria FROM consulta
  UNION ALL SELECT id_paciente, 'tipo_prueba', tipo_prueba FROM laboratorio) GROUP BY 1, 2, 3"""
)

PSI_COLS = list(NUMERIC_FEATURES)


def psi_sql(served: str = "conjunto = 'test'") -> str:
    parts = []
    for c in PSI_COLS:
        x = f"CAST(COALESCE(CAST({c} AS DOUBLE), 0.0) AS DOUBLE)"
        binned = (
            f"CASE WHEN r.hi IS NULL OR r.hi <= r.lo THEN 0 ELSE LEAST(GREATEST(CAST(floor(({x} - r.lo) / ((r.hi - r.lo) / 10)) AS INTEGER), 0), 9) END"
        )
        parts.append(
            f"""SELECT '{c}' AS campo, ROUND(SUM((GREATEST(COALESCE(a.s, 0.0), 1e-4) - GREATEST(COALESCE(e.s, 0.0), 1e-4))
                 * LN(GREATEST(COALESCE(a.s, 0.0), 1e-4) / GREATEST(COALESCE(e.s, 0.0), 1e-4))), 6) AS psi
FROM range(10) b(bin)
LEFT JOIN (SELECT b, COUNT(*) / SUM(COUNT(*)) OVER () AS s FROM (SELECT {binned} AS b FROM ft JOIN split USING (id_paciente), (SELECT MIN({x.replace(c, 'f2.' + c)}) AS lo, MAX({x.replace(c, 'f2.' + c)}) AS hi FROM ft f2 JOIN split s2 USING (id_paciente) WHERE s2.conjunto = 'train') r WHERE conjunto = 'train') GROUP BY b) e ON e.b = b.bin
LEFT JOIN (SELECT b, COUNT(*) / SUM(COUNT(*)) OVER () AS s FROM (SELECT {binned} AS b FROM ft JOIN split USING (id_paciente), (SELECT MIN({x.replace(c, 'f2.' + c)}) AS lo, MAX({x.replace(c, 'f2.' + c)}) AS hi FROM ft f2 JOIN split s2 USING (id_paciente) WHERE s2.conjunto = 'train') r WHERE {served}) GROUP BY b) a ON a.b = b.bin"""
        )
    split = """
split AS (
  SELECT id_paciente,
         CASE WHEN (('0x' || substr(md5(id_paciente || ':42'), 1, 8))::BIGINT % 10000) < 2000 THEN 'test' ELSE 'train' END AS conjunto
  FROM ft
)"""
    return with_fixtures(" UNION ALL ".join(parts), FEATURE_TABLE_CTES + "," + split)


FOLD = "translate({x}, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')"


def harmonisation_sql() -> str:
    cols = ["sexo", "zona_residencia", "estadio", "aseguradora", "tipo_cancer"]
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS campo, {c} AS valor FROM paciente WHERE {c} IS NOT NULL" for c in cols)
    key = "lower(" + FOLD.format(x="regexp_replace(valor, '^\\s+|\\s+$', '', 'g')") + ")"
    return with_fixtures(
        f"""
SELECT c.campo, c.valor, c.clave, k.canonico, c.n FROM counts c JOIN (
  SELECT campo, clave, {norm('valor')} AS canonico FROM (
    SELECT *, row_number() OVER (PARTITION BY campo, clave ORDER BY n DESC, valor) AS r FROM counts) WHERE r = 1
) k ON k.campo = c.campo AND k.clave = c.clave""",
        f"counts AS (SELECT campo, valor, COUNT(*) AS n, {key} AS clave FROM ({stacked}) GROUP BY campo, valor)",
    )


def harmonised_sql() -> str:
    cols = ["sexo", "zona_residencia", "estadio", "aseguradora"]
    key = "lower(" + FOLD.format(x="regexp_replace(valor, '^\\s+|\\s+$', '', 'g')") + ")"
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS campo, {c} AS valor FROM paciente WHERE {c} IS NOT NULL" for c in cols)
    joins = " ".join(f"LEFT JOIN palabras w_{c} ON w_{c}.campo = '{c}' AND w_{c}.valor = p.{c}" for c in cols)
    return with_fixtures(
        f"SELECT p.id_paciente, {', '.join(f'w_{c}.canonico AS {c}' for c in cols)} FROM paciente p {joins}",
        f"""
usos AS (SELECT campo, valor, count(*) AS n, {key} AS clave FROM ({stacked}) GROUP BY campo, valor),
palabras AS (
  SELECT campo, u.valor, {norm("first_value(u.valor) OVER (PARTITION BY campo, clave ORDER BY n DESC, u.valor)")} AS canonico FROM usos u
)""",
    )


# version after version: served if not below 95 % of the one served before
X18 = with_fixtures(
    """
SELECT t AS model_type, version, turned AS revertida, served AS version_servida, k = max(k) OVER (PARTITION BY t) AS ultima FROM paso""",
    """
mes AS (
  SELECT tipo_cancer AS t, strftime(fecha_dx, '%Y%m') AS version, avg(adherencia_12m::INTEGER) AS m, row_number() OVER (PARTITION BY tipo_cancer ORDER BY strftime(fecha_dx, '%Y%m')) AS k
  FROM paciente WHERE adherencia_12m IS NOT NULL GROUP BY 1, 2
),
paso AS (
  SELECT t, k, version, false AS turned, version AS served, m AS best FROM mes WHERE k = 1
  UNION ALL
  SELECT n.t, n.k, n.version, n.m < 0.95 * p.best, CASE WHEN n.m < 0.95 * p.best THEN p.served ELSE n.version END, CASE WHEN n.m < 0.95 * p.best THEN p.best ELSE n.m END
  FROM paso p JOIN mes n ON n.t = p.t AND n.k = p.k + 1
)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
NUM = "CAST(substr(id_paciente, 2) AS BIGINT)"
SPELLED = f"""
escritos AS (
  SELECT id_paciente,
         CASE WHEN {NUM} % 3 = 0 THEN CASE sexo WHEN 'F' THEN 'Femenino' ELSE 'MASCULINO' END WHEN {NUM} % 41 = 1 THEN 'femenimo' WHEN {NUM} % 43 = 1 THEN 'masc.' ELSE sexo END AS sexo,
         CASE WHEN {NUM} % 37 = 2 THEN 'urbna' WHEN {NUM} % 53 = 3 THEN 'Rurál ' ELSE zona_residencia END AS zona_residencia,
         estadio,
         CASE WHEN {NUM} % 47 = 4 THEN 'Subsidiada' WHEN {NUM} % 59 = 5 THEN 'Contributvo' WHEN {NUM} % 61 = 6 THEN 'esp' ELSE aseguradora END AS aseguradora
  FROM paciente
)"""
VARIANT_COLS = ["sexo", "zona_residencia", "estadio", "aseguradora"]


def variants_sql(body: str) -> str:
    """Pairs of spellings compared one with another, groups by recursion."""
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS campo, {c} AS valor FROM escritos WHERE {c} IS NOT NULL" for c in VARIANT_COLS)
    key = "lower(" + FOLD.format(x="regexp_replace(valor, '^\\s+|\\s+$', '', 'g')") + ")"
    ctes = SPELLED + f""",
usos AS (SELECT campo, valor, count(*) AS n, {key} AS clave FROM ({stacked}) GROUP BY campo, valor),
forma AS (SELECT campo, clave, sum(n) AS n, regexp_replace(clave, '\\.$', '') AS texto FROM usos GROUP BY campo, clave),
errata AS (
  SELECT a.campo, a.clave AS x, b.clave AS y FROM forma a JOIN forma b USING (campo)
  WHERE least(len(a.clave), len(b.clave)) >= 5 AND 10 * a.n <= b.n AND levenshtein(a.clave, b.clave) = 1 AND NOT regexp_matches(a.clave || b.clave, '[0-9]')
),
alcanza AS (
  SELECT campo, clave AS x, clave AS y FROM forma
  UNION
  SELECT r.campo, r.x, CASE WHEN r.y = e.x THEN e.y ELSE e.x END FROM alcanza r JOIN errata e ON r.campo = e.campo AND r.y IN (e.x, e.y)
),
grupo AS (SELECT campo, x AS clave, min(y) AS grupo FROM alcanza GROUP BY campo, x),
empieza AS (
  SELECT a.campo, a.clave AS breve, b.clave AS larga, len(b.texto) AS largo, g.grupo
  FROM forma a JOIN forma b ON a.campo = b.campo AND len(b.texto) > len(a.texto) AND starts_with(b.texto, a.texto)
  JOIN grupo g ON g.campo = b.campo AND g.clave = b.clave
  WHERE len(a.texto) <= 4 AND regexp_full_match(a.texto, '[\\p{{L}}]+')
),
breve AS (
  SELECT campo, breve, min(grupo) AS grupo FROM empieza e WHERE NOT EXISTS (FROM empieza o WHERE o.campo = e.campo AND o.breve = e.larga)
  GROUP BY campo, breve HAVING count(DISTINCT grupo) = 1 AND max(largo) >= 5
),
palabra AS (
  SELECT u.*, coalesce(b.grupo, g.grupo) AS grupo, b.breve IS NOT NULL AS es_breve
  FROM usos u JOIN grupo g USING (campo, clave) LEFT JOIN breve b ON b.campo = u.campo AND b.breve = u.clave
),
mapa AS (
  SELECT campo, valor, n, clave, {norm("first_value(valor) OVER (PARTITION BY campo, grupo ORDER BY es_breve, n DESC, valor)")} AS canonico FROM palabra
)"""
    return with_fixtures(body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


X21 = with_fixtures(
    "SELECT sha256('cohorte-demo-salt' || id_paciente) AS id_paciente, sexo, edad, zona_residencia, fecha_dx, tipo_cancer, "
    "estadio, aseguradora, adherencia_12m FROM paciente"
)

SQL.update(
    {
        "x1_cancer_type_detail": X1,
        "x1_stage_insurer_split": split_sql("tipo_cancer", ("estadio", "aseguradora")),
        "x2_recently_active": X2,
        "x3_patient_lab_analysis": X3,
        "x5_patients_by_type": X5A,
        "x5_visits_by_month": X5B,
        "x6_adherence_by_group": split_sql("x", ("sexo", "zona_residencia", "aseguradora"), keep_by=False).replace(
            "SELECT x AS g", "SELECT 'todos' AS g"
        ),
        "x7_lab_means_by_month": X7,
        "x9_adherence_goal": X9,
        "x10_early_stage_share": X10,
        "x11_time_to_treatment": X11,
        "x11_visits_with_last_lab": X11_LAST_LAB,
        "x12_visits_by_specialist": X12,
        "x13_abandonment": X13,
        "x14_service_use": X14,
        "x17_feature_drift": psi_sql(),
        "x17_drift_against_log": psi_sql("edad IS NOT NULL"),
        "x19_harmonisation_map": harmonisation_sql(),
        "x19_harmonised_patients": harmonised_sql(),
        "x18_served_versions": X18,
        "x19_variant_map": variants_sql("FROM mapa"),
        "x19_unified_patients": variants_sql(
            f"SELECT p.id_paciente, {', '.join(f'w_{c}.canonico AS {c}' for c in VARIANT_COLS)} FROM escritos p "
            + " ".join(f"LEFT JOIN mapa w_{c} ON w_{c}.campo = '{c}' AND w_{c}.valor = p.{c}" for c in VARIANT_COLS)
        ),
        "x21_anonymised_patients": X21,
    }
)
