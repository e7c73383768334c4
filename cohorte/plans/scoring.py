"""Batch scoring, input validation and prediction-log rows.

The reference scores one request at a time; here a whole DataFrame of
requests is validated and scored in one narrow pass (no shuffle), and every
request - scored or rejected - becomes one log row.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.plans.training import prepare, score
from cohorte.schemas import CATEGORICAL_FEATURES, MODEL_TYPES, NUMERIC_FEATURES

TEST_AVERAGES = ["avg_biopsia", "avg_vph", "avg_marcador_ca125", "avg_psa", "avg_colonoscopia"]
NON_NEGATIVE = ["count_consultas", "dias_desde_diagnostico", "count_laboratorios", "avg_resultado_numerico", *TEST_AVERAGES]


def validation_reasons(df: DataFrame) -> Column:
    """I12 rules as an array of messages (empty = valid)."""
    checks = [
        F.when(F.col("edad").isNull(), F.lit("edad: requerido")),
        F.when((F.col("edad") < 0) | (F.col("edad") > 120), F.lit("edad: fuera de rango 0-120")),
    ]
    for c in NON_NEGATIVE:
        if c in df.columns:
            checks.append(F.when(F.col(c) < 0, F.lit(f"{c}: debe ser >= 0")))
    checks.append(
        F.when(~F.coalesce(F.col("tipo_modelo").isin(*MODEL_TYPES), F.lit(False)), F.format_string("tipo_modelo: desconocido '%s'", F.col("tipo_modelo")))
    )
    return F.array_compact(F.array(*checks))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Default the five test averages to 0.0 and attach ``motivos``."""
    filled = requests.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TEST_AVERAGES})
    return filled.withColumn("motivos", validation_reasons(filled))


def score_requests(
    model: PipelineModel,
    requests: DataFrame,
    model_version: str,
    request_key: str = "id_paciente",
    at: datetime | None = None,
    inference_ms: float | None = None,
) -> DataFrame:
    """M11 + M12: validate, score the valid rows, and return one
    prediction-log row per request. Failures get prediction -1 and
    probability 0.0. ``request_id`` is a hash of (version, key, time), so a
    re-executed task writes the same ids. One projection: a rejected request
    passes through the model as well, its score is not used. The log holds the
    inputs as they were sent."""
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    sent = F.struct(
        *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES],
        *[F.col(c).cast("string").alias(c) for c in CATEGORICAL_FEATURES],
        F.col("tipo_modelo").alias("tipo_modelo"),
    )
    checked = validate_requests(requests.withColumn("_enviado", sent))
    scored = score(model, prepare(checked).withColumn("label", F.lit(0.0)))
    ok = F.size("motivos") == 0
    ts = F.lit(at).cast("timestamp")
    rid = F.sha2(F.concat_ws("|", F.lit(model_version), F.col(request_key).cast("string"), ts.cast("string")), 256)
    return scored.select(
        ts.alias("timestamp"),
        rid.alias("request_id"),
        F.lit(model_version).alias("model_version"),
        F.when(ok, F.col("prediccion").cast("int")).otherwise(-1).alias("prediction"),
        F.when(ok, F.col("probabilidad")).otherwise(0.0).alias("probability"),
        F.lit(inference_ms).cast("double").alias("inference_time_ms"),
        ok.alias("success"),
        F.when(~ok, F.array_join("motivos", "; ")).alias("error_message"),
        F.col("_enviado").alias("input_features"),
    )
