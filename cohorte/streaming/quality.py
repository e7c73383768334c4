"""X20 as a stream: predictions meet the labels that become known later.

Two streams, the prediction log and the labels (``request_id, conocida, etiqueta``),
are joined by request within ``label_delay`` of the prediction. A prediction whose
label doesn't come in that time is given out once without one, so nothing waits for
ever and the share of predictions without a label is known. State is bounded by the
delay: a prediction is dropped when it is given out, a label when no prediction
that it could belong to can still come.

The joined rows are a Parquet table that appends exactly once (the file sink's own
log). :func:`quality` computes the metrics and alerts over it, in all or by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohorte.operators.metrics import metric_columns
from cohorte.plans.kpis import ALERT_THRESHOLDS
from cohorte.schemas import PREDICTION_LOG

LABELS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), True),
        T.StructField("conocida", T.TimestampType(), True),
        T.StructField("etiqueta", T.IntegerType(), True),
    ]
)


def joined_labels(log: DataFrame, labels: DataFrame, label_delay: str, watermark: str) -> DataFrame:
    """Successful predictions with their label, or null after ``label_delay``. Batch or streaming."""
    if log.isStreaming:
        log, labels = log.withWatermark("timestamp", watermark), labels.withWatermark("conocida", watermark)
    p = log.where("success AND request_id IS NOT NULL").select("timestamp", "request_id", "model_version", "prediction", "probability")
    y = labels.where("request_id IS NOT NULL AND etiqueta IS NOT NULL").select(F.col("request_id").alias("_id"), "conocida", "etiqueta")
    near = (F.col("conocida") >= F.col("timestamp")) & (F.col("conocida") <= F.col("timestamp") + F.expr(f"INTERVAL {label_delay}"))
    return p.join(y, (F.col("request_id") == F.col("_id")) & near, "left_outer").drop("_id")


def start_quality_stream(
    spark: SparkSession,
    log_dir: str,
    labels_dir: str,
    out_dir: str,
    checkpoint: str,
    label_delay: str = "30 days",
    watermark: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    log = spark.readStream.schema(PREDICTION_LOG).option("recursiveFileLookup", True).json(log_dir)
    labels = spark.readStream.schema(LABELS).option("recursiveFileLookup", True).json(labels_dir)
    writer = joined_labels(log, labels, label_delay, watermark).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", out_dir).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def quality(joined: DataFrame, by: list[str] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """A16 metrics and alerts over predictions with a label, and how many have none; per group of ``by``."""
    th = thresholds or ALERT_THRESHOLDS
    keys = by or []
    known = F.col("etiqueta").isNotNull()
    cell = lambda p, y: F.count_if(known & (F.col("prediction") == p) & (F.col("etiqueta") == y)).cast("double")
    aggs = [cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fn"), F.count_if(known).alias("n"), F.count_if(~known).alias("sin_etiqueta")]
    c = joined.groupBy(*keys).agg(*aggs) if keys else joined.agg(*aggs)
    m = c.select(*keys, "n", "sin_etiqueta", *metric_columns(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))))
    return m.withColumns({f"alerta_{k}": F.col(k) < F.lit(v) for k, v in th.items()})
