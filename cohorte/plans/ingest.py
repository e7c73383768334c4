"""Q6: ingest a three-sheet batch into the clinical tables.

Order as in the reference: patients, then visits, then labs; children are
checked against the *merged* patient table. Per table:

    parse with reasons -> quarantine -> last-wins de-duplication ->
    (children) foreign-key check -> upsert into base -> statistics

Everything is one lazy plan per table; the only shuffles are on the key
(de-duplication, upsert) and on ``id_paciente`` (foreign-key check).

:func:`deliver` ingests into the keyed store: it reads and writes only the cells
that the batch falls into, and one commit makes all its tables visible at once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.functions.dates import ColumnFormats
from cohorte.functions.parse import DEFAULT_DATE_FORMATS
from cohorte.operators.quality import REASONS, dedupe_last, parse_sheet, quarantine_rows, sheet_formats, split_valid
from cohorte.operators.upsert import BROADCAST_KEYS, upsert, upsert_stats
from cohorte.plans.summaries import PATIENTS, summary_changes
from cohorte.schemas import TABLES
from cohorte.sources import store
from cohorte.sources.store import DEFAULT_CELLS, Snapshot, Work, version_id

ORDER = ("paciente", "consulta", "laboratorio")
ROW_ORDER = "_fila"


@dataclass
class IngestResult:
    tables: dict[str, DataFrame]
    stats: DataFrame
    errors: DataFrame


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with the declared schema (a local relation, which the
    optimizer folds away in the first upsert)."""
    fields = TABLES[name].schema.fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def _existing_parents(batch: DataFrame, parents: DataFrame, fk: str, n_rows: int | None) -> DataFrame:
    """Parent keys of the batch that exist, flagged ``_padre``.

    The patient table is large and the batch's distinct parent keys are
    few: when the batch is bounded (``n_rows`` <= BROADCAST_KEYS), its
    distinct keys are broadcast into a semi-join with the patient table, so
    the patient table is scanned but never shuffled; the found keys (no
    more than the batch's) are broadcast back. Otherwise the planner joins."""
    keys = parents.select(F.col("id_paciente").alias(fk))
    if n_rows is not None and n_rows <= BROADCAST_KEYS:
        wanted = batch.select(fk).where(F.col(fk).isNotNull()).distinct()
        found = keys.join(F.broadcast(wanted), fk, "left_semi")
        return F.broadcast(found.withColumn("_padre", F.lit(True)))
    return keys.withColumn("_padre", F.lit(True))


def ingest_table(
    raw: DataFrame,
    name: str,
    base: DataFrame,
    parents: DataFrame | None = None,
    order_col: str = ROW_ORDER,
    formats: tuple[str, ...] = DEFAULT_DATE_FORMATS,
    compat: bool = False,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One sheet into one table: returns (merged table, stats row, errors).

    ``parents`` is the (merged) patient table for child sheets. When
    ``materialise`` is given, the parsed batch is written once through it,
    and the FK check, the merge, the statistics and the quarantine all read
    that copy instead of parsing the batch again; its row count then bounds
    the broadcasts of the FK check and of the upsert."""
    spec = TABLES[name]
    if order_col not in raw.columns:
        raw = raw.withColumn(order_col, F.monotonically_increasing_id())
    parsed = parse_sheet(raw, spec, formats, compat)
    n_keys = None
    if materialise is not None:
        parsed = materialise(parsed)
        # all staged rows, bad ones too: an upper bound of the keys and of the
        # parent keys that may be broadcast
        n_keys = parsed.count()
    if spec.parent_key:
        if parents is None:
            raise ValueError(f"{name} necesita la tabla de pacientes")
        parsed = parsed.join(_existing_parents(parsed, parents, spec.parent_key, n_keys), spec.parent_key, "left")
    good, bad = split_valid(parsed, spec)
    table_errors = bad
    if spec.parent_key:
        orphans = quarantine_rows(
            good.where(F.col("_padre").isNull()),
            spec,
            F.array(F.format_string("id_paciente: paciente inexistente (%s)", F.col(spec.parent_key))),
        )
        table_errors = bad.unionByName(orphans)
        good = good.where(F.col("_padre")).drop("_padre")
    good = dedupe_last(good, spec.key, order_col).select(*spec.columns)
    merged = upsert(base, good, spec.key, n_keys)
    counts = upsert_stats(base, good, spec.key, n_keys)
    n_err = table_errors.agg(F.count(F.lit(1)).alias("errores"))
    stats = counts.select(F.lit(name).alias("tabla"), "insertados", "actualizados").join(
        n_err.select(F.lit(name).alias("tabla"), "errores"), "tabla"
    )
    return merged, stats, table_errors


def ingest(
    batch: dict[str, DataFrame],
    base: dict[str, DataFrame] | None = None,
    order_col: str = ROW_ORDER,
    formats: tuple[str, ...] = DEFAULT_DATE_FORMATS,
    compat: bool = False,
) -> IngestResult:
    """Merge one batch of raw sheets into ``base`` (empty tables if None), as
    lazy plans; :func:`deliver` is the form that writes.

    ``order_col`` orders rows inside the batch (last wins for a repeated
    key). When a sheet lacks it, the scan order is used
    (``monotonically_increasing_id``, stable for the same input files)."""
    missing = [n for n in ORDER if n not in batch]
    if missing:
        raise ValueError(f"Hoja requerida '{missing[0]}' no encontrada")
    spark = next(iter(batch.values())).sparkSession
    base = base or {n: empty_table(spark, n) for n in ORDER}
    merged: dict[str, DataFrame] = {}
    stats, errors = [], []
    for name in ORDER:
        m, st, err = ingest_table(batch[name], name, base[name], merged.get("paciente"), order_col, formats, compat)
        merged[name] = m
        stats.append(st)
        errors.append(err)
    all_stats = stats[0].unionByName(stats[1]).unionByName(stats[2])
    all_errors = errors[0].unionByName(errors[1]).unionByName(errors[2])
    return IngestResult(merged, all_stats, all_errors)


#: Value of ``formats``: infer them.
INFER = "inferir"
ERRORS = "_errores"
STATS_SCHEMA = "tabla string, insertados long, actualizados long, errores long"


@dataclass
class Delivery:
    """What a delivery did: its version, per table (insertados, actualizados, errores), where its bad rows are."""

    version: str
    stats: dict[str, dict[str, int]]
    errors_path: str | None
    replayed: bool = False
    formats: dict[str, ColumnFormats] = field(default_factory=dict)
    spark: SparkSession | None = field(default=None, repr=False)

    def stats_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(t, s["insertados"], s["actualizados"], s["errores"]) for t, s in self.stats.items()], STATS_SCHEMA)

    def errors(self) -> DataFrame:
        return self.spark.read.schema("tabla string, clave string, mensaje string").parquet(self.errors_path)


def _dealt(raw: DataFrame) -> DataFrame:
    """A sheet over all cores: a small file of many rows would be parsed by one task."""
    cores = raw.sparkSession.sparkContext.defaultParallelism
    return raw if raw.rdd.getNumPartitions() >= cores else raw.repartition(cores)


def _staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = os.path.join(folder, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deliver(
    spark: SparkSession,
    root: str,
    sheets: dict[str, DataFrame],
    order_col: str = ROW_ORDER,
    formats: tuple[str, ...] | str = DEFAULT_DATE_FORMATS,
    compat: bool = False,
    stream: tuple[str, int] | None = None,
    n_cells: int = DEFAULT_CELLS,
    summaries: bool | None = None,
) -> Delivery:
    """Q6 into the keyed store: some or all sheets, parents first, one commit.

    Every sheet is parsed once and staged. Children are checked against the
    patients of this delivery and of the cells that their parent keys fall
    into. Good rows are merged into the cells of their keys; the tables, the
    patient summaries and the quarantined rows become visible together. The
    summaries are kept up if the store has them (None), or from now on (True). A
    stream's batch that was committed before changes nothing. ``n_cells`` is the least
    number of cells of a new table; one that begins large has more.

    ``formats=INFER`` takes the date format of each column from the whole column
    (:mod:`cohorte.functions.dates`); what was found is in the delivery."""
    names = [n for n in ORDER if n in sheets]
    now = store.latest(spark, root)
    if stream and now.streams.get(stream[0], -1) >= stream[1]:
        return _replayed(spark, now)
    run = uuid.uuid4().hex[:12]
    folder = os.path.join(root, store.STAGED, run)
    parsed, rows, found = {}, {}, {}
    for name in names:
        raw = sheets[name] if order_col in sheets[name].columns else sheets[name].withColumn(order_col, F.monotonically_increasing_id())
        own = formats
        if formats == INFER:
            own = sheet_formats(raw, TABLES[name])
            found |= {f"{name}.{c}": f for c, f in own.items()}
        parsed[name] = _staged(parse_sheet(_dealt(raw), TABLES[name], own, compat), folder, name)
        rows[name] = parsed[name].count()  # bounds the keys and parent keys

    def work(at: Snapshot) -> Work:
        attempt = os.path.join(folder, uuid.uuid4().hex[:8])
        changes, reads, errors, stats, good_rows = [], {}, [], {}, {}
        for name in names:
            spec = TABLES[name]
            good, bad = split_valid(parsed[name], spec)
            if spec.parent_key:
                good, orphans, cells = _checked(spark, root, at, good, spec, rows[name], good_rows.get("paciente"))
                bad = bad.unionByName(orphans)
                if cells is not None:
                    reads["paciente"] = reads.get("paciente", set()) | cells
            good = _staged(dedupe_last(good, spec.key, order_col).select(*spec.columns), attempt, name)
            good_rows[name] = (good, rows[name])
            n_good = good.count()
            stats[name] = {"insertados": 0, "actualizados": 0, "errores": 0}
            errors.append(bad.select("tabla", "clave", "mensaje"))
            if n_good or name not in at.tables:
                change = store.merge(good, root, name, at, (spec.key,), rows[name], store.cells_for(n_good, n_cells), n_good)
                changes.append(change)
                stats[name] |= {"insertados": change.inserted, "actualizados": change.updated}
        out = Work(changes, reads, {"estadisticas": stats, "formatos": {c: [f.state, *f.formats, *("|".join(p) for p in f.undecided)] for c, f in found.items()}})
        if summaries or (summaries is None and PATIENTS in at.tables):
            more = summary_changes(spark, root, at, good_rows, store.cells_for(max((n for _, n in good_rows.values()), default=0), n_cells))
            out.changes += more.changes
            for name, cells in more.reads.items():
                out.reads[name] = None if cells is None or out.reads.get(name, set()) is None else out.reads.get(name, set()) | cells
        all_errors = errors[0]
        for e in errors[1:]:
            all_errors = all_errors.unionByName(e)
        out.info["errores"] = os.path.join(ERRORS, *(names if len(names) == 1 else ()), f"batch={uuid.uuid4().hex[:12]}")
        path = os.path.join(root, out.info["errores"])
        all_errors.write.parquet(path)
        for r in spark.read.schema(all_errors.schema).parquet(path).groupBy("tabla").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per sheet
            stats[r["tabla"]]["errores"] = r["n"]
        return out

    at, done = store.transact(spark, root, work, stream)
    fs, p, _ = store._fs(spark, folder)
    fs.delete(p, True)
    return _replayed(spark, at) if done is None else Delivery(version_id(at.version), at.info["estadisticas"], os.path.join(root, at.info["errores"]), False, found, spark)


def _replayed(spark: SparkSession, at: Snapshot) -> Delivery:
    return Delivery(version_id(at.version), {}, None, True, {}, spark)


def _checked(
    spark: SparkSession, root: str, at: Snapshot, good: DataFrame, spec, n_rows: int, patients: tuple[DataFrame, int] | None
) -> tuple[DataFrame, DataFrame, set[int] | None]:
    """I9 on the store: rows with a parent, orphans as quarantined rows, and the patient cells that were read."""
    key = spec.parent_key
    keys = patients[0].select("id_paciente") if patients else None
    cells = None
    if "paciente" in at.tables:
        cells = store.touched_cells(good, [key], at.tables["paciente"].n_cells)
        stored = store.read(spark, root, "paciente", at, cells).select("id_paciente")
        keys = stored if keys is None else keys.unionByName(stored).distinct()
    if keys is None:
        keys = empty_table(spark, "paciente").select("id_paciente")
    flagged = good.join(_existing_parents(good, keys, key, n_rows), key, "left")
    orphans = quarantine_rows(flagged.where(F.col("_padre").isNull()), spec, F.array(F.format_string("id_paciente: paciente inexistente (%s)", F.col(key))))
    return flagged.where(F.col("_padre")).drop("_padre"), orphans, cells
