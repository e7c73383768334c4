"""Model artefacts and the model registry table.

A trained ``PipelineModel`` is saved with Spark ML persistence under
``<root>/<model_type>/<version>``; one row per training run is appended to
the Parquet table ``<root>/_registry``. The newest model of a type is found
with ``max_by(path, trained_at)`` on that table, not by listing files.

A vocabulary that is too large for the model's own parameters is a table; it is
saved inside the model's folder and found relative to it, so a saved model needs
nothing else and can be moved.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.operators.encode import LabelVocabularyModel
from cohorte.schemas import MODEL_REGISTRY, MODEL_TYPES

#: Folder of a model's large vocabularies, inside the model's own.
WORDS = "vocabulario"


def registry_path(root: str) -> str:
    return os.path.join(root.rstrip("/"), "_registry")


def new_version(now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    return "v" + now.strftime("%Y%m%d_%H%M%S_%f")


def save_model(spark: SparkSession, root: str, model: PipelineModel, record: dict) -> str:
    """Persist the model and append its registry row; returns the path."""
    if record["model_type"] not in MODEL_TYPES:
        raise ValueError(f"tipo de modelo desconocido: {record['model_type']}")
    path = os.path.join(root.rstrip("/"), record["model_type"], record["version"])
    stages, words = [], []
    for stage in model.stages:
        if isinstance(stage, LabelVocabularyModel) and (tables := json.loads(stage.getOrDefault(stage.tables))):
            inside = {c: f"{WORDS}/{len(words)}-{i}" for i, c in enumerate(tables)}
            words += [(tables[c], c, inside[c]) for c in tables]
            stage = stage.copy({stage.tables: json.dumps(inside)})
        stages.append(stage)
    PipelineModel(stages=stages).write().overwrite().save(path)
    for folder, c, name in words:
        spark.read.parquet(folder).where(F.col("campo") == c).write.parquet(os.path.join(path, name))
    row = dict(record, path=path)
    spark.createDataFrame([tuple(row.get(f.name) for f in MODEL_REGISTRY.fields)], MODEL_REGISTRY).write.mode(
        "append"
    ).parquet(registry_path(root))
    return path


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MODEL_REGISTRY).parquet(registry_path(root))


def latest_entry(spark: SparkSession, root: str, model_type: str) -> dict:
    """Newest registry row of a type; error when there is none."""
    reg = read_registry(spark, root).where(F.col("model_type") == model_type)
    row = reg.agg(F.max_by(F.struct(*reg.columns), "trained_at").alias("r")).first()
    if row is None or row["r"] is None:
        raise FileNotFoundError(f"No hay modelos entrenados de tipo {model_type}")
    return row["r"].asDict()


def load_model(path: str) -> PipelineModel:
    """A saved model, its vocabularies where they lie now."""
    model = PipelineModel.load(path)
    for stage in model.stages:
        if isinstance(stage, LabelVocabularyModel):
            tables = json.loads(stage.getOrDefault(stage.tables))
            stage._set(tables=json.dumps({c: os.path.join(path, f) if f.startswith(f"{WORDS}/") else f for c, f in tables.items()}))
    return model


def load_latest(spark: SparkSession, root: str, model_type: str) -> tuple[PipelineModel, dict]:
    entry = latest_entry(spark, root, model_type)
    return load_model(entry["path"]), entry


def load_version(spark: SparkSession, root: str, model_type: str, version: str) -> tuple[PipelineModel, dict]:
    row = read_registry(spark, root).where((F.col("model_type") == model_type) & (F.col("version") == version)).first()
    if row is None:
        raise FileNotFoundError(f"No hay modelo {model_type} {version}")
    return load_model(row["path"]), row.asDict()


def version_from_path(path_col: str = "path") -> F.Column:
    """version text from an artefact path: ``_v<digits…>`` suffix, else
    the last path component."""
    p = F.col(path_col)
    v = F.regexp_extract(p, r"(v\d[\w]*)/?$", 1)
    return F.when(v != "", v).otherwise(F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1))
