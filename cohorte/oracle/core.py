"""Oracle SQL for the four analytical queries (Q1-Q4), each from its definition.

Visits and labs are first summed up per patient; a patient without any keeps
the empty summary.
"""

from cohorte.oracle import AS_OF, SQL, with_fixtures

# Message texts of the results.
NO_LABS = "Sin datos de laboratorio"
BAD_ORDER = "DATOS INCONSISTENTES: La fecha de diagnóstico es anterior a la primera prueba de laboratorio"
NO_VISITS = "Sin consultas registradas"

# one row per patient with any visit: all visit dates in order, and how many are recent
VISITS = f"""
visitas AS (
  SELECT id_paciente, list_sort(list(fecha_consulta)) AS fechas, count(*) AS n,
         count_if(fecha_consulta >= {AS_OF} - INTERVAL 6 MONTH) AS recientes
  FROM consulta GROUP BY id_paciente
)"""

Q1_LAB_DX_GAP = with_fixtures(
    f"""
SELECT p.*, u.fecha_muestra AS primera_fecha_lab, date_diff('day', u.fecha_muestra, p.fecha_dx)::INTEGER AS dias_entre_lab_y_dx,
       CASE WHEN u.fecha_muestra IS NULL THEN '{NO_LABS}' WHEN u.fecha_muestra > p.fecha_dx THEN '{BAD_ORDER}' END AS mensaje_consistencia
FROM paciente p LEFT JOIN primeras u USING (id_paciente)""",
    """
primeras AS (
  SELECT DISTINCT ON (id_paciente) id_paciente, fecha_muestra FROM laboratorio ORDER BY id_paciente, fecha_muestra NULLS LAST
)""",
)

Q2_INACTIVE = with_fixtures(
    f"""
SELECT p.*, v.fechas[-1] AS ultima_consulta, ({AS_OF} - v.fechas[-1])::INTEGER AS dias_sin_consulta, coalesce(v.n, 0) AS total_consultas,
       coalesce('Inactivo por ' || ({AS_OF} - v.fechas[-1]) || ' días', '{NO_VISITS}') AS estado_actividad
FROM paciente p LEFT JOIN visitas v USING (id_paciente)
WHERE v.id_paciente IS NULL OR v.fechas[-1] + 90 < {AS_OF}""",
    VISITS,
)

# A patient's age counts once for every pair of a visit and a lab, and once
# where one of them is missing; the counts are plain sums per type.
Q3_DASHBOARD = with_fixtures(
    """
SELECT tipo_cancer, count(*) AS total_pacientes,
       round(sum(edad * peso) / sum(peso) FILTER (edad IS NOT NULL), 2) AS promedio_edad,
       round(avg(edad), 2) AS promedio_edad_paciente,
       sum(recientes)::BIGINT AS consultas_ultimos_6_meses, sum(labs)::BIGINT AS total_laboratorios
FROM (
  SELECT p.tipo_cancer, p.edad, coalesce(v.recientes, 0) AS recientes, coalesce(m.labs, 0) AS labs,
         greatest(coalesce(v.n, 0), 1) * greatest(coalesce(m.labs, 0), 1) AS peso
  FROM paciente p LEFT JOIN visitas v USING (id_paciente)
  LEFT JOIN (SELECT id_paciente, count(*) AS labs FROM laboratorio GROUP BY 1) m USING (id_paciente)
)
GROUP BY tipo_cancer""",
    VISITS,
)

# The tests whose results have an average of their own.
BUCKETS = {
    "biopsia": ("biopsia",),
    "vph": ("vph",),
    "marcador_ca125": ("ca125", "marcador"),
    "psa": ("psa",),
    "colonoscopia": ("colonoscopia",),
}


def _mean(words: tuple[str, ...]) -> str:
    """A lab summary's mean over the results of the tests that any word names; 0 without one."""
    named = " OR ".join(f"contains(x.tipo, '{w}')" for w in words) or "true"
    return f"round(coalesce(list_avg([x.valor FOR x IN m.pruebas IF ({named}) AND x.valor IS NOT NULL]), 0), 2)"


def _exact_mean(words: tuple[str, ...]) -> str:
    """The same over results as decimals, whose sum has no rounding."""
    named = " OR ".join(f"contains(x.tipo, '{w}')" for w in words) or "true"
    values = f"[x.valor::DECIMAL(28, 9) FOR x IN m.pruebas IF ({named}) AND x.valor IS NOT NULL]"
    return f"round(coalesce(list_sum({values})::DOUBLE / nullif(len({values}), 0), 0), 2)"


def feature_table_ctes(mean) -> str:
    return f"""
mediciones AS (
  SELECT id_paciente, count(*) AS n, list({{'tipo': lower(tipo_prueba), 'valor': resultado_numerico}}) AS pruebas
  FROM laboratorio GROUP BY id_paciente
), asistencia AS (SELECT id_paciente, count(*) AS n FROM consulta GROUP BY id_paciente),
ft AS (
  SELECT p.id_paciente, sexo, edad, ifnull(zona_residencia, 'Desconocida') AS zona_residencia, tipo_cancer, estadio, aseguradora,
         ifnull(a.n, 0) AS count_consultas, date_diff('day', fecha_dx, {AS_OF})::INTEGER AS dias_desde_diagnostico,
         ifnull(m.n, 0) AS count_laboratorios, {mean(())} AS avg_resultado_numerico,
         {", ".join(f"{mean(words)} AS avg_{name}" for name, words in BUCKETS.items())},
         ifnull(adherencia_12m, false)::INTEGER AS adherencia_12m
  FROM paciente p LEFT JOIN asistencia a USING (id_paciente) LEFT JOIN mediciones m USING (id_paciente)
  WHERE NOT (sexo IS NULL OR tipo_cancer IS NULL OR estadio IS NULL OR aseguradora IS NULL)
)"""

FEATURE_TABLE_CTES = feature_table_ctes(_mean)
Q4_EXACT = with_fixtures("FROM ft", feature_table_ctes(_exact_mean))
Q4_FEATURES = with_fixtures("FROM ft", FEATURE_TABLE_CTES)


SQL.update({
    "q1_lab_dx_gap": Q1_LAB_DX_GAP,
    "q2_inactive_patients": Q2_INACTIVE,
    "q3_dashboard_by_type": Q3_DASHBOARD,
    "q4_feature_table": Q4_FEATURES,
})
