"""Registered ML queries (M1-M12, A16/A17, I12, S6-S9, O7) over the whole
feature table derived from the fixture tables."""

from __future__ import annotations

import math
import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.functions.numeric import round_to
from cohorte.operators.encode import LabelVocabulary, vocabulary
from cohorte.operators.metrics import classification_metrics
from cohorte.operators.scale import PopulationScaler
from cohorte.operators.split import assign_exact_split, assign_split, train_test
from cohorte.plans import queries as Q
from cohorte.plans.registry import register
from cohorte.plans.scoring import score_requests, validate_requests
from cohorte.plans.training import KEY, LBFGS, MINIBATCH, TrainingResult, prepare, prepared, score, train_prepared
from cohorte.schemas import CATEGORICAL_FEATURES, FEATURES, MODEL_FEATURES, NUMERIC_FEATURES
from cohorte.session import scratch_path
from cohorte.sources.fixtures import AS_OF, clinical_tables
from cohorte.sources.logs import append_log, last_predictions, read_log
from cohorte.sources.registry import load_latest, new_version, save_model
from cohorte.sources.tables import latest_feature_csv, write_feature_csv

SCORING_TIME = datetime(2001, 8, 1, 12, 0, 0)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clinical_tables(spark, sf_dir)
    return Q.feature_table(t["paciente"], t["consulta"], t["laboratorio"], as_of=AS_OF, ordered=False)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepare(feature_table(spark, sf_dir))
    return LabelVocabulary(inputCols=CATEGORICAL_FEATURES).fit(data).transform(data)


_MODELS: dict[tuple[str, str, str, str], TrainingResult] = {}
_PREPARED: dict[tuple[str, str], DataFrame] = {}


def prepared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared feature table, written once per (session, data) for all models."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        _PREPARED[key] = prepared(feature_table(spark, sf_dir))
    return _PREPARED[key]


def trained(spark: SparkSession, sf_dir: str, kind: str, loop: str = LBFGS) -> TrainingResult:
    """Train once per (session, data, kind)."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, loop)
    if key not in _MODELS:
        _MODELS[key] = train_prepared(prepared_table(spark, sf_dir), kind, loop=loop)
    return _MODELS[key]


@register("m1_label_vocabulary")
def _m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(feature_table(spark, sf_dir), CATEGORICAL_FEATURES)


@register("m2_encoded_features")
def _m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select(KEY, *MODEL_FEATURES, "label")


@register("m3_split")
def _m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(feature_table(spark, sf_dir).select(KEY, "adherencia_12m"), KEY, 0.2, 42)


@register("m3_exact_split")
def _m3e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_exact_split(feature_table(spark, sf_dir).select(KEY, "adherencia_12m"), KEY, "adherencia_12m", 0.2, 42)


@register("m4_scaler_stats")
def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_df, _ = train_test(encoded(spark, sf_dir), KEY, 0.2, 42)
    stats = PopulationScaler(inputCols=MODEL_FEATURES).fit(train_df).get_stats()
    rows = [(c, m, s) for c, (m, s) in stats.items()]
    df = spark.createDataFrame(rows, "campo string, media double, desviacion double")
    return df.select("campo", round_to("media", 6).alias("media"), round_to("desviacion", 6).alias("desviacion"))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic rule score to evaluate: visits / (visits + 10)."""
    f = feature_table(spark, sf_dir)
    p = F.col("count_consultas") / (F.col("count_consultas") + F.lit(10.0))
    return f.select(F.col("adherencia_12m").alias("label"), p.alias("probability"), (p > 0.5).cast("int").alias("prediction"))


@register("a16_a17_baseline_metrics")
def _a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_metrics(baseline_scores(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir).withColumn("tipo_modelo", F.lit("xgboost"))


@register("i12_scoring_validation")
def _i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate_requests(requests(spark, sf_dir))
    return v.select(KEY, (F.size("motivos") == 0).alias("valido"), F.array_join("motivos", "; ").alias("motivos"))


def _test_scores(kind: str, loop: str = LBFGS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        res = trained(spark, sf_dir, kind, loop)
        _, test_df = train_test(prepared_table(spark, sf_dir), KEY, 0.2, 42)
        return score(res.model, test_df).select(KEY, "label", "probabilidad", "prediccion")

    return run


register("m5_gbt_test_scores")(_test_scores("xgboost"))
register("m6_mlp_test_scores")(_test_scores("neural_network"))


register("m6_minibatch_test_scores")(_test_scores("neural_network", MINIBATCH))

#: Name in the results -> (type, training).
MODELS = {"xgboost": ("xgboost", LBFGS), "neural_network": ("neural_network", LBFGS), "minibatch": ("neural_network", MINIBATCH)}


@register("m6_minibatch_curve")
def _m6curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per epoch on the training and the validation rows."""
    h = trained(spark, sf_dir, "neural_network", MINIBATCH).history
    rows = [(e["epoca"], e["perdida"], e["perdida_validacion"], e["exactitud_validacion"]) for e in h]
    return spark.createDataFrame(rows, "epoca int, perdida double, perdida_validacion double, exactitud_validacion double")


@register("m6_minibatch_epochs")
def _m6epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every epoch saw: rows trained on and measured on, and whether the
    loss is below that of guessing (ln 2) once half of the epochs are done."""
    h = trained(spark, sf_dir, "neural_network", MINIBATCH).history
    rows = [(e["epoca"], e["filas_entrenamiento"], e["filas_validacion"], e["epoca"] <= 25 or e["perdida"] < math.log(2)) for e in h]
    return spark.createDataFrame(rows, "epoca int, filas_entrenamiento long, filas_validacion long, aprende boolean")


@register("m5_m6_score_contract")
def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patient of the test part once per model, with its label, a
    probability, and the prediction that follows from it."""
    _, test_df = train_test(prepared_table(spark, sf_dir), KEY, 0.2, 42)
    out = None
    for name, (kind, loop) in MODELS.items():
        s = score(trained(spark, sf_dir, kind, loop).model, test_df)
        part = s.select(
            F.lit(name).alias("modelo"), KEY, F.col("label").cast("int").alias("label"),
            F.col("probabilidad").between(0, 1).alias("en_rango"),
            (F.col("prediccion") == (F.col("probabilidad") > 0.5).cast("int")).alias("coherente"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@register("m7_metrics_recomputed")
def _m7r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported test metrics against ones recomputed from written predictions
    by plain aggregates."""
    _, test_df = train_test(prepared_table(spark, sf_dir), KEY, 0.2, 42)
    out = None
    for name, (kind, loop) in MODELS.items():
        res = trained(spark, sf_dir, kind, loop)
        path = scratch_path(spark, f"predicciones-{uuid.uuid4().hex[:12]}")
        score(res.model, test_df).select(F.col("label").cast("int").alias("y"), F.col("probabilidad").alias("p"), F.col("prediccion").alias("c")).write.parquet(path)
        view = f"predicciones_{name}"
        spark.read.parquet(path).createOrReplaceTempView(view)
        m = res.metrics_test
        f1 = "coalesce(2 * count_if(c = 1 AND y = 1) / nullif(2 * count_if(c = 1 AND y = 1) + count_if(c <> y), 0), 0)"
        part = spark.sql(
            f"""
            SELECT '{name}' AS modelo, count(*) AS n, abs(avg(CAST(c = y AS DOUBLE)) - {m['accuracy']}D) < 1e-4 AS exactitud_igual,
                   abs({f1} - {m['f1_score']}D) < 1e-4 AS f1_igual
            FROM {view}"""
        )
        out = part if out is None else out.unionByName(part)
    return out


@register("m11_score_contract")
def _m11c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request once in the log, valid ones with a probability and a prediction, others with -1 and 0."""
    rows = _m11(spark, sf_dir)
    ok = F.col("success")
    right = F.when(ok, F.col("probability").between(0, 1) & (F.col("prediction") == (F.col("probability") > 0.5).cast("int"))).otherwise(
        (F.col("prediction") == -1) & (F.col("probability") == 0)
    )
    return rows.select(ok.alias("success"), "error_message", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("hora"), right.alias("coherente"), F.length("request_id").alias("largo_id")).groupBy(
        "success", "error_message", "hora", "coherente", "largo_id"
    ).agg(F.count(F.lit(1)).alias("solicitudes"))


@register("m7_model_metrics")
def _m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for kind in ("xgboost", "neural_network"):
        res = trained(spark, sf_dir, kind)
        for part, m in (("train", res.metrics_train), ("test", res.metrics_test)):
            rows.append((kind, part, int(m["n"]), m["accuracy"], m["precision"], m["recall"], m["f1_score"], m["auc"], float(res.train_seconds)))
    return spark.createDataFrame(
        rows, "modelo string, conjunto string, n long, accuracy double, precision double, recall double, f1_score double, auc double, train_seconds double"
    )


def _model_root(spark: SparkSession) -> str:
    return scratch_path(spark, f"models-{os.getpid()}")


@register("m11_batch_scoring")
def _m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, register (S8), load the newest (S9) and score every patient."""
    res = trained(spark, sf_dir, "xgboost")
    root = _model_root(spark)
    version = new_version()
    save_model(spark, root, res.model, res.record(version))
    model, entry = load_latest(spark, root, "xgboost")
    return score_requests(model, requests(spark, sf_dir), entry["version"], at=SCORING_TIME)


@register("s7_prediction_log")
def _s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the scoring rows to a JSON log (S6), read it back (S7) and
    keep the newest 1000 (O7)."""
    rows = _m11(spark, sf_dir)
    path = scratch_path(spark, f"prediction-log-{os.getpid()}-{datetime.now().strftime('%H%M%S%f')}")
    append_log(rows, path)
    return last_predictions(read_log(spark, path), 1000).drop("fecha")


def rule_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-log rows of a rule score (visits / (visits + 10)), one a
    patient, seven seconds apart by the number in the patient's id."""
    f = feature_table(spark, sf_dir)
    p = F.col("count_consultas") / (F.col("count_consultas") + F.lit(10.0))
    ok = F.col("edad").isNotNull()
    seconds = F.substring(KEY, 2, 20).cast("long") * 7
    return f.select(
        F.timestamp_seconds(F.unix_timestamp(F.lit(SCORING_TIME)) + seconds).alias("timestamp"),
        F.col(KEY).alias("request_id"),
        F.lit("regla-1").alias("model_version"),
        F.when(ok, (p > 0.5).cast("int")).otherwise(-1).alias("prediction"),
        F.when(ok, p).otherwise(0.0).alias("probability"),
        (seconds % 50).cast("double").alias("inference_time_ms"),
        ok.alias("success"),
        F.when(~ok, F.lit("edad: requerido")).alias("error_message"),
        F.struct(
            *(F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES), *(F.col(c) for c in CATEGORICAL_FEATURES), F.lit("regla").alias("tipo_modelo")
        ).alias("input_features"),
    )


def written_rule_log(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, f"rule-log-{uuid.uuid4().hex[:12]}")
    append_log(rule_log(spark, sf_dir), path)
    return path


@register("s7_log_tail")
def _s7t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7, O7 on distinct times: the newest 1000 rows of a written log."""
    tail = last_predictions(read_log(spark, written_rule_log(spark, sf_dir)), 1000)
    return tail.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("hora"), "request_id", "prediction", round_to("probability", 6).alias("probability"), "success")


@register("s5_feature_csv")
def _s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table written as CSV, and the newest one read."""
    folder = scratch_path(spark, f"features-{uuid.uuid4().hex[:12]}")
    write_feature_csv(feature_table(spark, sf_dir), folder, "20010801_120000")
    return latest_feature_csv(spark, folder, FEATURES)


@register("m12_log_outcomes")
def _m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 outcomes of scoring every patient: requests per (success, error
    message) and how many carry a valid 0/1 prediction (failures carry -1).
    Deterministic although the probabilities are not."""
    rows = _m11(spark, sf_dir)
    return rows.groupBy("success", "error_message").agg(
        F.count(F.lit(1)).alias("solicitudes"),
        F.count_if(F.col("prediction").isin(0, 1)).alias("con_prediccion_valida"),
    )
