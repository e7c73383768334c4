"""Oracle SQL for the SQL-expressible ML steps (M1-M4, A16/A17, I12, M12 outcomes)."""

from __future__ import annotations

from cohorte.oracle import SQL, with_fixtures
from cohorte.oracle.core import FEATURE_TABLE_CTES
from cohorte.schemas import NUMERIC_FEATURES

NUMS = ", ".join(f"CAST(COALESCE(CAST({c} AS DOUBLE), 0.0) AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES)

VOCAB = """
vocab AS (
  SELECT campo, valor, CAST(row_number() OVER (PARTITION BY campo ORDER BY valor) - 1 AS INTEGER) AS codigo
  FROM (SELECT DISTINCT 'zona_residencia' AS campo, zona_residencia AS valor FROM ft WHERE zona_residencia IS NOT NULL
        UNION SELECT DISTINCT 'tipo_cancer', tipo_cancer FROM ft WHERE tipo_cancer IS NOT NULL)
),
enc AS (
  SELECT ft.id_paciente, """ + NUMS + """,
         COALESCE(vz.codigo, 0) AS zona_residencia_encoded,
         COALESCE(vt.codigo, 0) AS tipo_cancer_encoded,
         CAST(ft.adherencia_12m AS DOUBLE) AS label
  FROM ft
  LEFT JOIN vocab vz ON vz.campo = 'zona_residencia' AND vz.valor = ft.zona_residencia
  LEFT JOIN vocab vt ON vt.campo = 'tipo_cancer' AND vt.valor = ft.tipo_cancer
),
split AS (
  SELECT id_paciente,
         CASE WHEN (('0x' || substr(md5(id_paciente || ':42'), 1, 8))::BIGINT % 10000) < 2000 THEN 'test' ELSE 'train' END AS conjunto
  FROM ft
)"""

CTES = FEATURE_TABLE_CTES + "," + VOCAB

M4_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS campo, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS media, ROUND(STDDEV_POP(CAST({c} AS DOUBLE)), 6) AS desviacion "
    f"FROM enc JOIN split USING (id_paciente) WHERE conjunto = 'train'"
    for c in NUMERIC_FEATURES + ["zona_residencia_encoded", "tipo_cancer_encoded"]
)

BASELINE = """
sc AS (
  SELECT adherencia_12m AS label, count_consultas / (count_consultas + 10.0) AS probability,
         CASE WHEN count_consultas / (count_consultas + 10.0) > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM ft
),
cm AS (
  SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM sc
),
per AS (
  SELECT probability AS s, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
  FROM sc GROUP BY 1
),
cum AS (
  SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM per
),
auc AS (
  SELECT CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
              THEN SUM(pos * (neg_below + neg / 2.0)) / (SUM(pos) * SUM(neg)) END AS auc FROM cum
),
rates AS (
  SELECT *, tp + fp + tn + fn AS n,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS prec,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rec,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS spec
  FROM cm
)"""

A16 = """
SELECT n, tp, fp, tn, fn,
       ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, 4) AS accuracy,
       ROUND(prec, 4) AS precision, ROUND(rec, 4) AS recall,
       ROUND(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, 4) AS f1_score,
       ROUND((rec + spec) / 2, 4) AS balanced_accuracy,
       ROUND((SELECT auc FROM auc), 4) AS auc
FROM rates"""

NON_NEGATIVE = ["count_consultas", "dias_desde_diagnostico", "count_laboratorios", "avg_resultado_numerico",
                "avg_biopsia", "avg_vph", "avg_marcador_ca125", "avg_psa", "avg_colonoscopia"]
REASONS = ", ".join(
    ["CASE WHEN edad IS NULL THEN 'edad: requerido' END", "CASE WHEN edad < 0 OR edad > 120 THEN 'edad: fuera de rango 0-120' END"]
    + [f"CASE WHEN COALESCE({c}, 0.0) < 0 THEN '{c}: debe ser >= 0' END" for c in NON_NEGATIVE]
)
M12 = f"""
SELECT success, error_message, COUNT(*) AS solicitudes,
       COUNT(*) FILTER (WHERE success) AS con_prediccion_valida
FROM (SELECT msg = '' AS success, NULLIF(msg, '') AS error_message
      FROM (SELECT concat_ws('; ', {REASONS}) AS msg FROM ft))
GROUP BY success, error_message"""

LOG = """
registro AS (
  SELECT TIMESTAMP '2001-08-01 12:00:00' + INTERVAL 7 SECOND * CAST(substr(id_paciente, 2) AS BIGINT) AS hora, id_paciente AS request_id,
         edad IS NOT NULL AS success, count_consultas / (count_consultas + 10.0) AS p
  FROM ft
)"""
LOG_TAIL = """
SELECT strftime(hora, '%Y-%m-%d %H:%M:%S') AS hora, request_id, CASE WHEN NOT success THEN -1 WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction,
       round(CASE WHEN success THEN p ELSE 0 END, 6) AS probability, success
FROM registro ORDER BY registro.hora DESC LIMIT 1000"""
# windows of five minutes that end no later than ten minutes before the last row
LOG_WINDOWS = """
SELECT strftime(inicio, '%Y-%m-%d %H:%M:%S') AS inicio, 'regla-1' AS model_version, count(*) AS solicitudes,
       round(avg(p) FILTER (success), 6) AS probabilidad_media, round(avg(success::INTEGER), 6) AS tasa_exito
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, hora) AS inicio FROM registro) AS v
WHERE v.inicio + INTERVAL 5 MINUTE <= (SELECT max(hora) FROM registro) - INTERVAL 10 MINUTE
GROUP BY v.inicio"""

# the tenth of the rows that came after the rest is late where its window had been closed
LOG_LATE = """
SELECT CASE WHEN tarde THEN 'tardia' ELSE 'ventana' END AS clase, strftime(inicio, '%Y-%m-%d %H:%M:%S') AS inicio, 'regla-1' AS model_version,
       count(*) AS solicitudes, CASE WHEN NOT tarde THEN round(avg(p) FILTER (success), 6) END AS probabilidad_media,
       v.inicio + INTERVAL 5 MINUTE <= (SELECT max(hora) FROM registro) - INTERVAL 10 MINUTE AS cerrada
FROM (
  SELECT *, atrasada AND inicio + INTERVAL 5 MINUTE <= max(hora) FILTER (NOT atrasada) OVER () - INTERVAL 10 MINUTE AS tarde
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, hora) AS inicio, CAST(substr(request_id, 2) AS BIGINT) % 10 = 3 AS atrasada FROM registro)
) AS v GROUP BY v.tarde, v.inicio"""
LOG_SESSIONS = """
SELECT strftime(min(hora), '%Y-%m-%d %H:%M:%S') AS primera, strftime(max(hora), '%Y-%m-%d %H:%M:%S') AS ultima, 'regla-1' AS model_version,
       count(*) AS solicitudes, count_if(success) AS con_exito
FROM (
  SELECT *, sum(empieza) OVER (ORDER BY hora) AS sesion
  FROM (SELECT *, CASE WHEN hora - lag(hora) OVER (ORDER BY hora) <= INTERVAL 10 SECOND THEN 0 ELSE 1 END AS empieza FROM registro)
) GROUP BY sesion"""
# labels in time: for five patients in seven
LIVE = """
SELECT n, sin_etiqueta, round((tp + tn) / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1_score,
       round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 4) AS balanced_accuracy,
       (tp + tn) / n < 0.7 AS alerta_accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) < 0.7 AS alerta_f1_score
FROM (
  SELECT count_if(known) AS n, count_if(NOT known) AS sin_etiqueta, count_if(known AND yes AND y = 1) AS tp, count_if(known AND yes AND y = 0) AS fp,
         count_if(known AND NOT yes AND y = 0) AS tn, count_if(known AND NOT yes AND y = 1) AS fn
  FROM (
    SELECT CAST(substr(request_id, 2) AS BIGINT) % 7 > 1 AS known, p > 0.5 AS yes, adherencia_12m AS y
    FROM registro JOIN ft ON id_paciente = request_id WHERE success
  )
)"""
# two streams score every request once each
SHARED = f"""
SELECT v AS model_version, count(*) AS solicitudes, count(*) AS distintas, count_if(msg = '') AS con_exito
FROM (SELECT concat_ws('; ', {REASONS}) AS msg FROM ft), (VALUES ('v1'), ('v2')) AS versions(v) GROUP BY v"""

_BUCKET = "('0x' || substr(md5(id_paciente || ':{seed}'), 1, 8))::BIGINT % 10000"
TRAIN_TEST = "partes AS (SELECT *, " + _BUCKET.format(seed=42) + " < 2000 AS prueba, " + _BUCKET.format(seed=43) + " < 2000 AS validacion FROM ft)"
EPOCHS = """
SELECT e::INTEGER AS epoca, n AS filas_entrenamiento, v AS filas_validacion, true AS aprende
FROM range(1, 51) AS t(e), (SELECT count_if(NOT validacion) AS n, count_if(validacion) AS v FROM partes WHERE NOT prueba)"""
MODELS = "(VALUES ('xgboost'), ('neural_network'), ('minibatch')) AS m(modelo)"

SQL.update(
    {
        "m6_minibatch_epochs": with_fixtures(EPOCHS, FEATURE_TABLE_CTES + "," + TRAIN_TEST),
        "m5_m6_score_contract": with_fixtures(
            f"SELECT modelo, id_paciente, adherencia_12m AS label, true AS en_rango, true AS coherente FROM partes, {MODELS} WHERE prueba",
            FEATURE_TABLE_CTES + "," + TRAIN_TEST,
        ),
        "m7_metrics_recomputed": with_fixtures(
            f"SELECT modelo, count(*) AS n, true AS exactitud_igual, true AS f1_igual FROM partes, {MODELS} WHERE prueba GROUP BY modelo",
            FEATURE_TABLE_CTES + "," + TRAIN_TEST,
        ),
        "m11_score_contract": with_fixtures(
            f"SELECT success, error_message, '2001-08-01 12:00:00' AS hora, true AS coherente, 64 AS largo_id, solicitudes FROM ({M12})", FEATURE_TABLE_CTES
        ),
        "t2_shared_log": with_fixtures(SHARED, FEATURE_TABLE_CTES),
        "t3_windows_and_late": with_fixtures(LOG_LATE, FEATURE_TABLE_CTES + "," + LOG),
        "t3_sessions": with_fixtures(LOG_SESSIONS, FEATURE_TABLE_CTES + "," + LOG),
        "x20_stream_quality": with_fixtures(LIVE, FEATURE_TABLE_CTES + "," + LOG),
        "s5_feature_csv": with_fixtures("SELECT * REPLACE (coalesce(edad, 0) AS edad) FROM ft", FEATURE_TABLE_CTES),
        "s7_log_tail": with_fixtures(LOG_TAIL, FEATURE_TABLE_CTES + "," + LOG),
        "t3_stream_windows": with_fixtures(LOG_WINDOWS, FEATURE_TABLE_CTES + "," + LOG),
        "x20_rule_quality": with_fixtures(
            "SELECT n, accuracy, precision, recall, f1_score, balanced_accuracy, accuracy < 0.7 AS alerta_accuracy, f1_score < 0.7 AS alerta_f1_score FROM (" + A16 + ")",
            FEATURE_TABLE_CTES + "," + BASELINE,
        ),
        "m12_log_outcomes": with_fixtures(M12, FEATURE_TABLE_CTES),
        # the streamed log (T2) must have the same outcomes as batch scoring
        "t2_stream_outcomes": with_fixtures(M12, FEATURE_TABLE_CTES),
        "m1_label_vocabulary": with_fixtures("SELECT campo, valor, codigo FROM vocab", CTES),
        "m2_encoded_features": with_fixtures("SELECT * FROM enc", CTES),
        "m3_split": with_fixtures("SELECT id_paciente, adherencia_12m, conjunto FROM ft JOIN split USING (id_paciente)", CTES),
        "m3_exact_split": with_fixtures(
            "SELECT id_paciente, adherencia_12m, CASE WHEN row_number() OVER (PARTITION BY adherencia_12m ORDER BY substr(md5(id_paciente || ':42'), 1, 12)) "
            "<= floor(count(*) OVER (PARTITION BY adherencia_12m) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS conjunto FROM ft",
            FEATURE_TABLE_CTES,
        ),
        "m4_scaler_stats": with_fixtures(M4_PARTS, CTES),
        "a16_a17_baseline_metrics": with_fixtures(A16, FEATURE_TABLE_CTES + "," + BASELINE),
        "i12_scoring_validation": with_fixtures(
            "SELECT id_paciente, edad IS NOT NULL AND edad BETWEEN 0 AND 120 AS valido, "
            "concat_ws('; ', CASE WHEN edad IS NULL THEN 'edad: requerido' END, "
            "CASE WHEN edad < 0 OR edad > 120 THEN 'edad: fuera de rango 0-120' END) AS motivos FROM ft",
            FEATURE_TABLE_CTES,
        ),
    }
)
