"""Versioned tables (S3) and sheet loading.

The clinical tables live in the keyed store (:mod:`cohorte.sources.store`): one
chain of versions for all tables of a root, each made by one commit. A table is
never overwritten in place; readers take the newest version.
"""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohorte.schemas import TABLES, raw_schema
from cohorte.sources import store
from cohorte.sources.store import DEFAULT_CELLS, _fs, version_id


def list_versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Versions in which a table was written, oldest first."""
    out, before = [], None
    for v in store.versions(spark, root):
        now = store.snapshot(spark, root, v).tables.get(name)
        if now is not None and now != before:
            out.append(version_id(v))
        before = now
    return out


def write_version(df: DataFrame, root: str, name: str, version: str, n_cells: int = DEFAULT_CELLS) -> None:
    """``df`` as the whole table ``name`` in a version that must be above all others."""
    spark = df.sparkSession
    store.transact(spark, root, lambda _: store.Work([store.replace(df, root, name, (TABLES[name].key,), n_cells)]), version=int(version))


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame | None:
    return store.read(spark, root, name, store.snapshot(spark, root, int(version)), schema=TABLES[name].schema)


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return store.read(spark, root, name, store.latest(spark, root), schema=TABLES[name].schema)


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The three tables of one version; None where one of them is missing."""
    at = store.latest(spark, root)
    tables = {n: store.read(spark, root, n, at, schema=TABLES[n].schema) for n in TABLES}
    return None if any(v is None for v in tables.values()) else tables


def load_sheets(spark: SparkSession, path: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """One folder per sheet (``paciente``, ``consulta``, ``laboratorio``)
    under ``path``, read with a declared all-text schema; a missing sheet is
    an error."""
    out = {}
    for name, spec in TABLES.items():
        p = os.path.join(path, name)
        fs, hp, _ = _fs(spark, p)
        if not fs.exists(hp):
            raise ValueError(f"Hoja requerida '{name}' no encontrada en {path}")
        reader = spark.read.schema(raw_schema(spec))
        out[name] = reader.option("header", True).csv(p) if fmt == "csv" else reader.format(fmt).load(p)
    return out


def table_ddl(name: str, location: str) -> str:
    """``CREATE TABLE`` text for a clinical table (constraints are the
    checks of :mod:`cohorte.operators.quality`, not DDL)."""
    spec = TABLES[name]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in spec.schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{os.path.join(location, name)}'"


def create_tables(spark: SparkSession, location: str) -> list[str]:
    """Create the three tables in the session catalog."""
    for name in TABLES:
        spark.sql(table_ddl(name, location))
    return list(TABLES)


def drop_tables(spark: SparkSession) -> None:
    for name in reversed(list(TABLES)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_feature_csv(df: DataFrame, folder: str, run_ts: str) -> dict:
    """The feature dataset as header CSV under
    ``<folder>/dataset_modelado_<run_ts>``; returns path, rows and a
    description (the row count is a cheap aggregate over the written
    files, not a second computation of the features)."""
    from cohorte.operators.clean import fill_residual_missing, residual_counts

    path = os.path.join(folder, f"dataset_modelado_{run_ts}")
    # counted while the files are written, no pass of its own
    seen = Observation()
    df = fill_residual_missing(df.observe(seen, F.count(F.lit(1)).alias("_filas"), *residual_counts(df)))
    # the writer would strip texts otherwise
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, encoding="UTF-8", **whole).csv(path)
    n = df.sparkSession.read.option("header", True).csv(path).count()
    residual = {c: k for c, k in seen.get.items() if k and c != "_filas"}
    if residual:
        warnings.warn(f"valores numéricos faltantes reemplazados por 0: {residual}", stacklevel=2)
    # The answer's keys and description
    return {
        "ruta_archivo": path,
        "total_registros": n,
        "faltantes_reemplazados": residual,
        "descripcion": f"Dataset consolidado con {n} pacientes. Incluye: datos demográficos, clínicos, "
        "conteos de consultas/laboratorios, y promedios de resultados por tipo de prueba.",
    }


def latest_feature_csv(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Newest ``dataset_modelado_*`` folder (by modification time);
    error when there is none. Read with the declared schema."""
    fs, p, _ = _fs(spark, folder)
    cands = [st for st in (fs.listStatus(p) if fs.exists(p) else []) if st.getPath().getName().startswith("dataset_modelado_")]
    if not cands:
        raise FileNotFoundError(f"No hay datasets en {folder}")
    newest = max(cands, key=lambda st: (st.getModificationTime(), st.getPath().getName()))
    return spark.read.schema(schema).option("header", True).csv(newest.getPath().toString())
