"""Windowed model-performance metrics over the prediction log.

Event time is the log ``timestamp``; rows later than the watermark are
dropped. Per (window, model_version): requests, mean probability, success
rate, positive rate and the median latency (approximate quantile, a
mergeable sketch, so the state per window stays bounded).

:func:`start_window_stream` keeps the rows that come too late in a sink beside the
windows; :func:`start_session_stream` gives the sessions of each model version.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohorte.schemas import PREDICTION_LOG
from cohorte.sources import store


def window_metrics(log: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Works on a batch or a streaming DataFrame of log rows."""
    if log.isStreaming:
        log = log.withWatermark("timestamp", watermark)
    return log.groupBy(F.window("timestamp", window).alias("ventana"), "model_version").agg(
        F.count(F.lit(1)).alias("solicitudes"),
        F.avg(F.when(F.col("success"), F.col("probability"))).alias("probabilidad_media"),
        F.avg(F.col("success").cast("double")).alias("tasa_exito"),
        F.avg(F.when(F.col("success"), (F.col("prediction") == 1).cast("double"))).alias("tasa_positivos"),
        F.percentile_approx("inference_time_ms", 0.5, 10000).alias("latencia_mediana_ms"),
    )


def start_monitor_stream(
    spark: SparkSession,
    log_dir: str,
    out_dir: str,
    checkpoint: str,
    window: str = "5 minutes",
    watermark: str = "10 minutes",
    available_now: bool = False,
    output_mode: str = "append",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """``append`` (default) emits a window once the watermark passes its end
    into a Parquet sink. ``complete`` rewrites the whole (small: one row per
    window and version) result on every trigger through ``foreachBatch``,
    which also shows the still-open windows of a bounded run."""
    reader = spark.readStream.schema(PREDICTION_LOG).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = reader.json(log_dir)
    metrics = window_metrics(log, window, watermark).select(
        F.col("ventana.start").alias("inicio"), F.col("ventana.end").alias("fin"), "*"
    ).drop("ventana")
    if output_mode == "complete":
        def overwrite(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_dir)

        writer = metrics.writeStream.outputMode("complete").foreachBatch(overwrite)
    else:
        writer = metrics.writeStream.outputMode("append").format("parquet").option("path", out_dir)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


# -- windows and the rows that come too late for them ------------------------------

WINDOWS, LATE = "ventanas", "tardias"
_SUMS = ["solicitudes", "con_exito", "positivas", "suma_probabilidad", "suma_ms", "con_ms"]


def window_sums(log: DataFrame, window_ms: int) -> DataFrame:
    """Log rows as sums per (window, version); sums of parts add up to those of the whole."""
    at = F.unix_millis("timestamp")
    ok = F.coalesce(F.col("success"), F.lit(False))
    return log.groupBy(F.timestamp_millis(at - F.pmod(at, F.lit(window_ms))).alias("inicio"), "model_version").agg(
        F.count(F.lit(1)).alias("solicitudes"),
        F.count_if(ok).alias("con_exito"),
        F.count_if(ok & (F.col("prediction") == 1)).alias("positivas"),
        F.coalesce(F.sum(F.when(ok, F.col("probability"))), F.lit(0.0)).alias("suma_probabilidad"),
        F.coalesce(F.sum("inference_time_ms"), F.lit(0.0)).alias("suma_ms"),
        F.count("inference_time_ms").alias("con_ms"),
    )


def _add_batch(out_dir: str, stream: str, window_ms: int, delay_ms: int, n_cells: int):
    """One micro-batch: rows of open windows are added to these, the others go to the late rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def work(at: store.Snapshot) -> store.Work:
            rows = batch.where("timestamp IS NOT NULL").persist()
            mark = at.info.get("marca")
            ms = F.unix_millis("timestamp")
            end = ms - F.pmod(ms, F.lit(window_ms)) + window_ms
            closed = end <= F.lit(mark - delay_ms) if mark is not None else F.lit(False)
            last = rows.agg(F.max(ms)).first()[0]
            changes = [
                store.add(window_sums(rows.where(~closed), window_ms), out_dir, WINDOWS, at, ("inicio", "model_version"), n_cells, _SUMS),
                store.add(rows.where(closed), out_dir, LATE, at, ("request_id",), n_cells),
            ]
            rows.unpersist()
            return store.Work([c for c in changes if c], {}, {"marca": max(x for x in (mark, last) if x is not None)} if last is not None else dict(at.info))

        store.transact(spark, out_dir, work, (stream, batch_id))

    return run


def start_window_stream(
    spark: SparkSession,
    log_dir: str,
    out_dir: str,
    checkpoint: str,
    window_ms: int = 300_000,
    delay_ms: int = 600_000,
    available_now: bool = False,
    n_cells: int = 16,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Windows as in :func:`window_metrics`, and a sink for what comes too late.

    Spark's windowed aggregate drops late rows without a trace. Here every row is
    in a window or in the sink: a window closes when a batch before has seen a
    time ``delay_ms`` past its end, and rows of closed windows are kept apart. Both
    tables lie in the keyed store ``out_dir``, the monitor's own; a batch adds
    to the cells of its windows, and its commit carries the greatest time seen, so
    a batch that is delivered again adds nothing. Read with :func:`windows`."""
    reader = spark.readStream.schema(PREDICTION_LOG).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    name = checkpoint if "://" in checkpoint else os.path.abspath(checkpoint)
    writer = reader.json(log_dir).writeStream.foreachBatch(_add_batch(out_dir, name, window_ms, delay_ms, n_cells)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def windows(spark: SparkSession, out_dir: str, window_ms: int = 300_000, delay_ms: int = 600_000) -> DataFrame:
    """All windows so far with their sums; ``cerrada`` says which can't change any more."""
    at = store.latest(spark, out_dir)
    found = store.read(spark, out_dir, WINDOWS, at)
    if found is None:
        raise FileNotFoundError(f"{out_dir}: no log row was seen yet")
    return found.withColumn("cerrada", F.unix_millis("inicio") + window_ms <= F.lit(at.info["marca"] - delay_ms))


def late_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The log rows that came after their window was closed."""
    found = store.read(spark, out_dir, LATE, store.latest(spark, out_dir), schema=PREDICTION_LOG)
    return spark.createDataFrame([], PREDICTION_LOG) if found is None else found


# -- sessions ------------------------------------------------------------------------


def session_activity(log: DataFrame, gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Stretches of activity of a model version without a pause of ``gap``. Batch or streaming."""
    if log.isStreaming:
        log = log.withWatermark("timestamp", watermark)
    s = log.groupBy(F.session_window("timestamp", gap).alias("sesion"), "model_version").agg(
        F.count(F.lit(1)).alias("solicitudes"), F.max("timestamp").alias("ultima"), F.count_if("success").alias("con_exito")
    )
    return s.select(F.col("sesion.start").alias("primera"), "ultima", "model_version", "solicitudes", "con_exito")


def start_session_stream(
    spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str, gap: str = "5 minutes", watermark: str = "10 minutes", available_now: bool = False
) -> StreamingQuery:
    """Sessions appended once the watermark has passed their end."""
    log = spark.readStream.schema(PREDICTION_LOG).option("recursiveFileLookup", True).json(log_dir)
    writer = session_activity(log, gap, watermark).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", out_dir).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
