"""Continuous ingest of uploaded sheets with Structured Streaming.

Each table has a landing folder of CSV files (all-text declared schema).
``foreachBatch`` runs the batch ingest for that table (parse, quarantine,
dedupe, FK check, merge) into the keyed store: a micro-batch reads and writes
only the cells that its keys fall into, whatever the size of the table. Its
commit carries the stream (its checkpoint folder) and the batch id, so a batch
that is delivered again does nothing. Streams and batch jobs can share a store;
commits that touch different cells don't disturb each other.

Patients must be streamed before their children (FK check against the
current patient version), exactly as the batch ingest orders the sheets.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohorte.plans.ingest import ROW_ORDER, deliver
from cohorte.schemas import TABLES, raw_schema
from cohorte.sources.store import DEFAULT_CELLS
from pyspark.sql import types as T


def landing_schema(name: str) -> T.StructType:
    s = raw_schema(TABLES[name])
    return T.StructType(s.fields + [T.StructField(ROW_ORDER, T.LongType(), True)])


def _merge_batch(spark: SparkSession, name: str, table_root: str, order_col: str, stream: str, n_cells: int = DEFAULT_CELLS):
    def run(batch: DataFrame, batch_id: int) -> None:
        deliver(spark, table_root, {name: batch}, order_col, stream=(stream, batch_id), n_cells=n_cells)

    return run


def start_upload_stream(
    spark: SparkSession,
    name: str,
    landing: str,
    table_root: str,
    checkpoint: str,
    available_now: bool = False,
    order_col: str = ROW_ORDER,
    max_files_per_trigger: int | None = None,
    n_cells: int = DEFAULT_CELLS,
) -> StreamingQuery:
    reader = spark.readStream.schema(landing_schema(name)).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.csv(landing)
    writer = stream.writeStream.foreachBatch(
        _merge_batch(spark, name, table_root, order_col, os.path.abspath(checkpoint) if "://" not in checkpoint else checkpoint, n_cells)
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
