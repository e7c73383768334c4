"""Prediction log sink and scan.

The log is a folder of batches, ``lote=<name>/fecha=<day>/*.json`` (JSON lines). A
batch is written beside the log and appears whole, by one rename to its name. A
batch of a stream is named by its stream and number: delivered again, it finds its
name taken and adds nothing, and streams with checkpoints of their own never
replace each other's rows.

Micro-batches leave many small files. :func:`compact_log` writes the rows of the
batches so far anew, sorted by time in files of even size, and then names, in one
step, what they replace; readers see either form, never both.
:func:`vacuum_log` deletes what was replaced.

Reading uses the declared schema with ``PERMISSIVE`` mode: a malformed line lands in
``_corrupt_record`` and is counted and dropped instead of failing the scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorte.schemas import PREDICTION_LOG
from cohorte.sources.store import _fs, list_names, make_folders, publish, read_text, version_id, write_text

CORRUPT = "_corrupt_record"
BATCH, COMPACT = "lote=", "_compacto"
WRITTEN_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stream_batch(stream: str, batch_id: int) -> str:
    """Name of a stream's batch; ``stream`` is what tells streams apart (the checkpoint folder)."""
    return f"s-{hashlib.md5(stream.encode()).hexdigest()[:16]}-{batch_id:012d}"


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    fs, p, _ = _fs(spark, os.path.join(path, BATCH + batch))
    return bool(fs.exists(p)) or batch in _compacted(spark, path)["lotes"]


def _write_days(rows: DataFrame, path: str) -> None:
    out = rows.select(*[f.name for f in PREDICTION_LOG.fields]).withColumn("fecha", F.to_date("timestamp"))
    out.write.partitionBy("fecha").option("timestampFormat", WRITTEN_FORMAT).json(path)


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append prediction rows (PREDICTION_LOG columns) as one batch.

    A ``batch`` with a name is added once; False if the log has it already."""
    spark = rows.sparkSession
    name = batch or f"b-{uuid.uuid4().hex[:16]}"
    if batch and has_batch(spark, path, batch):
        return False
    draft = os.path.join(path, f"_borrador-{uuid.uuid4().hex[:16]}")
    _write_days(rows, draft)
    if publish(spark, draft, os.path.join(path, BATCH + name)):
        return True
    _delete(spark, draft)
    return False


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def _compacted(spark: SparkSession, path: str) -> dict:
    """The newest compaction: its number, the batches that it replaces, and the folders that hold their rows."""
    done = [n for n in list_names(spark, os.path.join(path, COMPACT)) if n.endswith(".json")]
    if not done:
        return {"numero": 0, "lotes": [], "carpetas": []}
    return json.loads(read_text(spark, os.path.join(path, COMPACT, done[-1])))


def _batches(spark: SparkSession, path: str, done: dict) -> list[str]:
    """Batches that no compaction has replaced."""
    gone = set(done["lotes"])
    return [n[len(BATCH) :] for n in list_names(spark, path) if n.startswith(BATCH) and n[len(BATCH) :] not in gone]


def _lines(spark: SparkSession, root: str, names: list[str], prefix: str = BATCH) -> DataFrame:
    """Rows of some batch folders, malformed ones flagged; all there is in ``root`` if no names are given."""
    reader = (
        spark.read.schema(T.StructType(PREDICTION_LOG.fields + [T.StructField(CORRUPT, T.StringType(), True)]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    )
    if not names:
        return reader.json(root)
    return reader.option("basePath", root).json([os.path.join(root, prefix + n) for n in names]).drop("lote", "batch")


def read_log(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """Parsed log rows; blank lines are skipped by the reader, malformed
    ones are dropped (``keep_corrupt=True`` returns them flagged). A folder
    that holds no batches is read as JSON lines as it stands."""
    done = _compacted(spark, path)
    top = list_names(spark, path)
    parts = [(os.path.join(path, COMPACT), done["carpetas"], BATCH), (path, _batches(spark, path, done), BATCH)]
    # logs written before there were batches, and those of streams then
    parts += [(path, [n[len(old) :] for n in top if n.startswith(old)], old) for old in ("fecha=", "batch=")]
    frames = [_lines(spark, root, names, prefix) for root, names, prefix in parts if names] or [_lines(spark, path, [])]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    if keep_corrupt:
        return df
    return df.where(F.col(CORRUPT).isNull() & F.col("timestamp").isNotNull()).drop(CORRUPT)


def malformed_count(spark: SparkSession, path: str) -> int:
    df = read_log(spark, path, keep_corrupt=True)
    return df.where(F.col(CORRUPT).isNotNull() | F.col("timestamp").isNull()).count()


def last_predictions(log: DataFrame, n: int = 1000) -> DataFrame:
    """The newest ``n`` predictions (a top-k: TakeOrderedAndProject)."""
    return log.orderBy(F.col("timestamp").desc(), F.col("request_id")).limit(n)


def compact_log(spark: SparkSession, path: str, least: int = 2) -> dict[str, int]:
    """Write the rows of all batches that aren't compacted yet into few files.

    Batches that arrive meanwhile stay as they are. Of two compactions at once
    one wins, the other changes nothing. Malformed lines stay with the batch that
    has them: such a batch isn't replaced."""
    done = _compacted(spark, path)
    batches = _batches(spark, path, done)
    if batches:
        bad = _lines(spark, path, batches).where(F.col(CORRUPT).isNotNull() | F.col("timestamp").isNull())
        broken = {r["b"] for r in bad.select(F.regexp_extract(F.input_file_name(), f"{BATCH}([^/]+)/", 1).alias("b")).distinct().collect()}  # batches, not rows
        batches = [b for b in batches if b not in broken]
    if len(batches) < least:
        return {"lotes": 0, "archivos": 0}
    rows = _lines(spark, path, batches).drop(CORRUPT)
    name = f"c-{uuid.uuid4().hex[:16]}"
    folder = os.path.join(path, COMPACT, BATCH + name)
    # ranges of time: a busy day is many files, quiet days share a task
    _write_days(rows.repartitionByRange("timestamp", "request_id"), folder)
    new = {"numero": done["numero"] + 1, "lotes": sorted({*done["lotes"], *batches}), "carpetas": [*done["carpetas"], name]}
    draft = os.path.join(path, COMPACT, f"_borrador-{uuid.uuid4().hex[:16]}")
    make_folders(spark, os.path.join(path, COMPACT))
    write_text(spark, draft, json.dumps(new))
    if not publish(spark, draft, os.path.join(path, COMPACT, f"{version_id(new['numero'])}.json")):
        _delete(spark, draft)
        _delete(spark, folder)
        return {"lotes": 0, "archivos": 0}
    files = spark.read.schema(PREDICTION_LOG).json(folder).inputFiles()
    return {"lotes": len(batches), "archivos": len(files)}


def vacuum_log(spark: SparkSession, path: str, min_age_hours: float = 24.0) -> int:
    """Delete batches that a compaction replaced and drafts that nobody published, once they are older than readers take."""
    gone = {BATCH + b for b in _compacted(spark, path)["lotes"]}
    fs, p, _ = _fs(spark, path)
    horizon = (time.time() - min_age_hours * 3600) * 1000
    n = 0
    for st in fs.listStatus(p) if fs.exists(p) else []:
        name = st.getPath().getName()
        if (name in gone or name.startswith("_borrador-")) and st.getModificationTime() < horizon:
            n += bool(fs.delete(st.getPath(), True))
    return n
