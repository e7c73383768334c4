"""Registered streaming queries (T1-T3). Each writes its input (derived
from the whole fixture tables) into a fresh scratch folder, runs the stream
to completion with ``trigger(availableNow=True)`` and returns the sink."""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.functions.numeric import round_to
from cohorte.plans.catalog_ml import SCORING_TIME, feature_table, requests, rule_log, trained, written_rule_log
from cohorte.plans.registry import register
from cohorte.schemas import PREDICTION_LOG
from cohorte.session import scratch_path
from cohorte.sources.fixtures import raw_deliveries
from cohorte.sources.logs import append_log, compact_log, read_log
from cohorte.sources.tables import read_latest
from cohorte.streaming.monitor import late_rows, start_monitor_stream, start_session_stream, start_window_stream, windows
from cohorte.streaming.quality import LABELS, quality, start_quality_stream
from cohorte.streaming.scoring import REQUEST_SCHEMA, _score_batch, start_scoring_stream, stream_id
from cohorte.streaming.uploads import start_upload_stream


def _run_dir(spark: SparkSession, what: str) -> str:
    return scratch_path(spark, f"{what}-{uuid.uuid4().hex[:12]}")


def streamed_tables(spark: SparkSession, sf_dir: str, names=("paciente", "consulta")) -> str:
    """Land the two deliveries one after the other and let the stream of
    each sheet pick them up, as uploads arrive in time: after a delivery
    lands, the stream resumes from its checkpoint and ingests only the new
    files. Files keep their natural partitioning (no single-task write)."""
    run = _run_dir(spark, "t1")
    tables = os.path.join(run, "tablas")
    for i, delivery in enumerate(raw_deliveries(spark, sf_dir)):
        for n in names:
            delivery[n].write.mode("overwrite").option("header", True).csv(os.path.join(run, "landing", n, f"entrega={i}"))
        for n in names:  # patients first: children are checked against them
            q = start_upload_stream(
                spark, n, os.path.join(run, "landing", n, "*"), tables, os.path.join(run, "_chk", n), available_now=True,
            )
            q.awaitTermination()
    return tables


@register("t1_stream_ingest_consulta")
def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_latest(spark, streamed_tables(spark, sf_dir), "consulta")


@register("t1_stream_ingest_laboratorio")
def _t1l(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = streamed_tables(spark, sf_dir, names=("paciente", "laboratorio"))
    return read_latest(spark, root, "laboratorio")


def scored_log(spark: SparkSession, sf_dir: str) -> str:
    run = _run_dir(spark, "t2")
    res = trained(spark, sf_dir, "xgboost")
    reqs = requests(spark, sf_dir).select(*[f.name for f in REQUEST_SCHEMA.fields])
    reqs.write.mode("overwrite").json(os.path.join(run, "solicitudes"))
    q = start_scoring_stream(
        spark, res.model, "stream-v1", os.path.join(run, "solicitudes"), os.path.join(run, "log"),
        os.path.join(run, "_chk"), available_now=True,
    )
    q.awaitTermination()
    return os.path.join(run, "log")


@register("t2_stream_scoring")
def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_log(spark, scored_log(spark, sf_dir)).select(*[f.name for f in PREDICTION_LOG.fields])


@register("t2_stream_outcomes")
def _t2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per outcome of the streamed log: must equal batch M12."""
    log = read_log(spark, scored_log(spark, sf_dir))
    return log.groupBy("success", "error_message").agg(
        F.count(F.lit(1)).alias("solicitudes"),
        F.count_if(F.col("prediction").isin(0, 1)).alias("con_prediccion_valida"),
    )


@register("t2_shared_log")
def _t2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own on one log, a micro-batch that
    is delivered again, and a compaction between them: rows per version."""
    run = _run_dir(spark, "t2s")
    res = trained(spark, sf_dir, "xgboost")
    folder, log = os.path.join(run, "solicitudes"), os.path.join(run, "log")
    reqs = requests(spark, sf_dir).select(*[f.name for f in REQUEST_SCHEMA.fields])
    reqs.write.json(folder)
    for version in ("v1", "v2"):
        checkpoint = os.path.join(run, f"_chk-{version}")
        start_scoring_stream(spark, res.model, version, folder, log, checkpoint, available_now=True).awaitTermination()
        _score_batch(res.model, version, log, stream_id(checkpoint))(spark.read.schema(REQUEST_SCHEMA).json(folder), 0)
        compact_log(spark, log, least=1)
    return read_log(spark, log).groupBy("model_version").agg(
        F.count(F.lit(1)).alias("solicitudes"),
        F.count_distinct("request_id").alias("distintas"),
        F.count_if("success").alias("con_exito"),
    )


@register("t3_stream_monitor")
def _t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scored_log(spark, sf_dir)
    run = _run_dir(spark, "t3")
    q = start_monitor_stream(
        spark, log, os.path.join(run, "metricas"), os.path.join(run, "_chk"), window="5 minutes", watermark="10 minutes",
        available_now=True, output_mode="complete",
    )
    q.awaitTermination()
    return spark.read.parquet(os.path.join(run, "metricas")).select(
        "inicio", "fin", "model_version", "solicitudes", "probabilidad_media", "tasa_exito", "tasa_positivos",
        F.col("latencia_mediana_ms"),
    )


@register("t3_stream_windows")
def _t3w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 in append mode on a log with spread times: the windows that the
    watermark closes (state of closed windows is dropped)."""
    run = _run_dir(spark, "t3w")
    q = start_monitor_stream(
        spark, written_rule_log(spark, sf_dir), os.path.join(run, "metricas"), os.path.join(run, "_chk"), window="5 minutes", watermark="10 minutes", available_now=True
    )
    q.awaitTermination()
    return spark.read.parquet(os.path.join(run, "metricas")).select(
        F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "model_version", "solicitudes",
        F.round("probabilidad_media", 6).alias("probabilidad_media"), F.round("tasa_exito", 6).alias("tasa_exito"),
    )


def _sentinel(spark: SparkSession, log: str, rows: DataFrame) -> None:
    """A row far ahead of a log's end: it moves the watermark, as time would, and stays open itself."""
    last = rows.agg(F.max("timestamp")).first()[0]
    row = (last + timedelta(days=400), "reloj", "reloj", 0, 0.0, None, True, None, None)
    append_log(spark.createDataFrame([row], PREDICTION_LOG), log)


def _number(c: str):
    return F.substring(c, 2, 20).cast("long")


@register("t3_windows_and_late")
def _t3late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 with a tenth of the log delivered after the rest: every row is in a
    closed window or, if the watermark had closed its window, in the late sink."""
    run = _run_dir(spark, "t3l")
    log, out = os.path.join(run, "log"), os.path.join(run, "ventanas")
    rows = rule_log(spark, sf_dir)
    delayed = _number("request_id") % 10 == 3
    for part in (rows.where(~delayed), rows.where(delayed)):
        append_log(part, log)
        start_window_stream(spark, log, out, os.path.join(run, "_chk"), available_now=True, n_cells=4).awaitTermination()
    late = late_rows(spark, out).select(F.unix_millis("timestamp").alias("ms"), "model_version")
    late = late.groupBy(F.timestamp_millis(F.col("ms") - F.pmod("ms", F.lit(300_000))).alias("inicio"), "model_version").agg(F.count(F.lit(1)).alias("solicitudes"))
    stamp = F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("inicio")
    return windows(spark, out).select(
        F.lit("ventana").alias("clase"), stamp, "model_version", "solicitudes", round_to(F.col("suma_probabilidad") / F.nullif("con_exito", F.lit(0)), 6).alias("probabilidad_media"), "cerrada"
    ).unionByName(late.select(F.lit("tardia").alias("clase"), stamp, "model_version", "solicitudes", F.lit(None).cast("double").alias("probabilidad_media"), F.lit(True).alias("cerrada")))


@register("t3_sessions")
def _t3sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the rule log: stretches without a pause of ten seconds."""
    run = _run_dir(spark, "t3s")
    log, out = os.path.join(run, "log"), os.path.join(run, "sesiones")
    rows = rule_log(spark, sf_dir)
    append_log(rows, log)
    start_session_stream(spark, log, out, os.path.join(run, "_chk"), gap="10 seconds", available_now=True).awaitTermination()
    _sentinel(spark, log, rows)
    start_session_stream(spark, log, out, os.path.join(run, "_chk"), gap="10 seconds", available_now=True).awaitTermination()
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(out).select(stamp("primera"), stamp("ultima"), "model_version", "solicitudes", "con_exito")


@register("x20_stream_quality")
def _x20s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20 as a stream: labels come an hour after the prediction, for one patient
    in seven too late, for one never."""
    run = _run_dir(spark, "x20s")
    log, labels, out = (os.path.join(run, d) for d in ("log", "etiquetas", "evaluadas"))
    rows = rule_log(spark, sf_dir)
    kind = _number("id_paciente") % 7
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(SCORING_TIME)) + _number("id_paciente") * 7 + F.when(kind == 1, 3).otherwise(1) * 3600)
    known = feature_table(spark, sf_dir).where(kind != 0).select(F.col("id_paciente").alias("request_id"), at.alias("conocida"), F.col("adherencia_12m").alias("etiqueta"))
    append_log(rows, log)
    known.write.json(os.path.join(labels, "1"))
    start = lambda: start_quality_stream(spark, log, labels, out, os.path.join(run, "_chk"), label_delay="2 hours", available_now=True).awaitTermination()
    start()
    _sentinel(spark, log, rows)
    last = known.agg(F.max("conocida")).first()[0]
    spark.createDataFrame([("reloj, etiqueta", last + timedelta(days=400), 0)], LABELS).write.json(os.path.join(labels, "2"))
    start()
    return quality(spark.read.parquet(out))
