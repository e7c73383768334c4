"""Continuous scoring of incoming requests into the prediction log.

Requests arrive as JSON files (feature-table columns plus ``tipo_modelo``).
The model is loaded once when the query starts. Each micro-batch is
validated (I12), scored (M11) and added to the log (M12) as one batch that is
named by the stream (its checkpoint folder) and the batch number: a replayed
batch adds nothing, and a stream with a new checkpoint, as for a new model, adds
to the same log. The batch wall time divided by its row count is recorded as
``inference_time_ms``.
"""

from __future__ import annotations

import os
import time
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohorte.plans.scoring import score_requests
from cohorte.schemas import FEATURES
from cohorte.sources.logs import append_log, has_batch, stream_batch

REQUEST_SCHEMA = T.StructType(
    [f for f in FEATURES.fields if f.name != "adherencia_12m"] + [T.StructField("tipo_modelo", T.StringType(), True)]
)


def _score_batch(model: PipelineModel, version: str, log_root: str, stream: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        name = stream_batch(stream, batch_id)
        if has_batch(batch.sparkSession, log_root, name):
            return
        start = time.time()
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = score_requests(model, batch, version, at=at).persist()
        n = rows.count()
        ms = (time.time() - start) * 1000.0 / max(n, 1)
        append_log(rows.withColumn("inference_time_ms", F.lit(ms)), log_root, name)
        rows.unpersist()

    return run


def stream_id(checkpoint: str) -> str:
    """What tells a stream from others: its checkpoint folder."""
    return checkpoint if "://" in checkpoint else os.path.abspath(checkpoint)


def start_scoring_stream(
    spark: SparkSession,
    model: PipelineModel,
    model_version: str,
    requests_dir: str,
    log_root: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    stream = spark.readStream.schema(REQUEST_SCHEMA).json(requests_dir)
    writer = stream.writeStream.foreachBatch(_score_batch(model, model_version, log_root, stream_id(checkpoint))).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
