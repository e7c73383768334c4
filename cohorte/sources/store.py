"""Keyed tables under one chain of commits.

A table is split into cells by a hash of its key. A write puts new files for the
cells that it changes into a folder of its own and touches nothing else; a
*commit*, one small JSON file, then names for every table where each cell lies now.
Readers take the newest commit, so all tables of a commit appear at once, and a job
that dies before its commit changes nothing for anybody.

    <root>/_commits/<version>.json      what each version consists of
    <root>/datos/<table>/<write>/_celda=<n>/*.parquet

Commits are numbered without gaps and created only if the number is free. A
writer that finds its number taken looks at what was committed meanwhile: if
neither the cells that it wrote nor those that it read have changed, its changes
go on top of the newer version; else its work runs again from there. So no update
is lost and every commit is as if the writers had come one after the other.

A commit remembers the last batch of each stream. A batch that is delivered again
finds itself there and does nothing.

The number must be taken in one step: a rename that doesn't replace (as on HDFS),
a hard link on a local file system. Object stores whose rename copies need a
committer that offers one.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorte.operators.upsert import BROADCAST_KEYS, upsert

VERSION_WIDTH = 20
CELL = "_celda"
COMMITS, DATA, STAGED = "_commits", "datos", "_preparado"
#: Cells of a new table. On a cluster: about the table's bytes / 128 MB.
DEFAULT_CELLS = 64
#: A cell is written by one task: rows that it should hold at most.
CELL_ROWS = 250_000
#: Attempts of a transaction whose cells keep changing under it.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """The version was committed by somebody else."""


@dataclass(frozen=True)
class Table:
    """Where the cells of a table lie: cell -> (write, rows). Cells without rows are absent."""

    key: tuple[str, ...]
    n_cells: int
    schema: T.StructType
    cells: dict[int, tuple[str, int]]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.cells.values())


@dataclass(frozen=True)
class Snapshot:
    version: int
    tables: dict[str, Table] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    info: dict = field(default_factory=dict)


EMPTY = Snapshot(0)


@dataclass
class Change:
    """New cells of one table. ``whole``: cells that aren't named are gone."""

    name: str
    table: Table
    whole: bool = False
    inserted: int = 0
    updated: int = 0


@dataclass
class Work:
    """What a transaction does, and which cells of which tables it has read (None: all)."""

    changes: list[Change]
    reads: dict[str, set[int] | None] = field(default_factory=dict)
    info: dict = field(default_factory=dict)


# -- files ---------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, draft: str, path: str) -> bool:
    """Give ``draft`` (a file or folder) the name ``path`` if it is free, in one step; False if it is taken."""
    fs, target, jvm = _fs(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(draft)
    if fs.getScheme() == "file":
        a, b = source.toUri().getPath(), target.toUri().getPath()
        try:
            if os.path.isdir(a):
                os.rename(a, b)  # fails on a folder that holds anything
            else:
                os.link(a, b)
                os.unlink(a)
            return True
        except OSError:
            if os.path.exists(b):
                return False
            raise
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, none)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise


def make_folders(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.mkdirs(p)


# -- versions ------------------------------------------------------------------


def version_id(n: int) -> str:
    return str(n).zfill(VERSION_WIDTH)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first (a directory listing)."""
    names = list_names(spark, os.path.join(root, COMMITS))
    return [int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("_")]


def _to_json(s: Snapshot) -> str:
    tables = {
        name: {"clave": list(t.key), "celdas": t.n_cells, "esquema": t.schema.jsonValue(), "datos": {str(c): list(w) for c, w in sorted(t.cells.items())}}
        for name, t in s.tables.items()
    }
    return json.dumps({"version": s.version, "hora": datetime.now(timezone.utc).isoformat(), "tablas": tables, "flujos": s.streams, "info": s.info}, ensure_ascii=False)


def snapshot(spark: SparkSession, root: str, version: int) -> Snapshot:
    raw = json.loads(read_text(spark, os.path.join(root, COMMITS, f"{version_id(version)}.json")))
    tables = {
        name: Table(tuple(t["clave"]), t["celdas"], T.StructType.fromJson(t["esquema"]), {int(c): (w[0], w[1]) for c, w in t["datos"].items()})
        for name, t in raw["tablas"].items()
    }
    return Snapshot(raw["version"], tables, raw["flujos"], raw["info"])


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The newest version; :data:`EMPTY` where nothing was committed yet."""
    all_versions = versions(spark, root)
    return snapshot(spark, root, all_versions[-1]) if all_versions else EMPTY


def commit(spark: SparkSession, root: str, new: Snapshot) -> Snapshot:
    """Make ``new`` a version, or raise :class:`Conflict` if its number is taken."""
    folder = os.path.join(root, COMMITS)
    make_folders(spark, folder)
    draft = os.path.join(folder, f"_borrador-{uuid.uuid4().hex}")
    write_text(spark, draft, _to_json(new))
    if not publish(spark, draft, os.path.join(folder, f"{version_id(new.version)}.json")):
        fs, p, _ = _fs(spark, draft)
        fs.delete(p, False)
        raise Conflict(f"version {new.version} was committed meanwhile")
    return new


def _applied(base: Snapshot, changes: list[Change], version: int, stream: tuple[str, int] | None, info: dict) -> Snapshot:
    tables = dict(base.tables)
    for c in changes:
        old = tables.get(c.name)
        cells = dict(c.table.cells) if c.whole or old is None else {**old.cells, **c.table.cells}
        cells = {n: w for n, w in cells.items() if w[1]}
        tables[c.name] = Table(c.table.key, c.table.n_cells, c.table.schema, cells)
    streams = dict(base.streams)
    if stream:
        streams[stream[0]] = stream[1]
    return Snapshot(version, tables, streams, info)


def _untouched(was: Snapshot, now: Snapshot, work: Work) -> bool:
    """Nothing that ``work`` read or wrote has changed between two versions."""
    cells: dict[str, set[int] | None] = dict(work.reads)
    for c in work.changes:
        seen = cells.get(c.name, set())
        cells[c.name] = None if c.whole or seen is None else seen | set(c.table.cells)
    for name, which in cells.items():
        a, b = was.tables.get(name), now.tables.get(name)
        if a == b:
            continue
        if a is None or b is None or which is None or a.n_cells != b.n_cells:
            return False
        if any(a.cells.get(c) != b.cells.get(c) for c in which):
            return False
    return True


def transact(
    spark: SparkSession,
    root: str,
    work: Callable[[Snapshot], Work],
    stream: tuple[str, int] | None = None,
    version: int | None = None,
    attempts: int = ATTEMPTS,
) -> tuple[Snapshot, Work | None]:
    """Run ``work`` on the newest version and commit its changes; see the module's text on conflicts.

    ``stream`` is the batch's origin (stream, number): if it was committed
    before, nothing runs and the work is None. A given ``version`` is a number
    that must be free and above all others.
    """
    done: Work | None = None
    base = EMPTY
    for attempt in range(attempts):
        now = latest(spark, root)
        if stream and now.streams.get(stream[0], -1) >= stream[1]:
            return now, None
        if done is None or not _untouched(base, now, done):
            base, done = now, work(now)
        number = now.version + 1 if version is None else version
        if number <= now.version:
            raise Conflict(f"version {number} isn't above {now.version}")
        try:
            return commit(spark, root, _applied(now, done.changes, number, stream, done.info)), done
        except Conflict:
            if version is not None:
                raise
            time.sleep(min(0.05 * 2**attempt, 2.0))
    raise Conflict(f"{root}: other writers changed the same cells {attempts} times")


# -- cells ---------------------------------------------------------------------


def cell_of(key: tuple[str, ...] | list[str], n_cells: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_cells)).cast("int")


def read(spark: SparkSession, root: str, name: str, at: Snapshot, cells: set[int] | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """A table of a version, or only some of its cells; None if the version has no such table."""
    t = at.tables.get(name)
    if t is None:
        return None
    wanted = sorted(c for c, (_, n) in t.cells.items() if n and (cells is None or c in cells))
    schema = schema or t.schema
    if not wanted:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    # the folders of a write that is whole are read as one
    paths = [os.path.join(root, DATA, name, t.cells[c][0], f"{CELL}={c}") for c in wanted]
    return spark.read.schema(schema).parquet(*paths)


def write_cells(df: DataFrame, root: str, name: str, key: tuple[str, ...], n_cells: int, grouped: bool = True) -> tuple[str, dict[int, tuple[str, int]]]:
    """Write rows by cell into a folder of their own. ``grouped`` deals the rows by
    cell first (one shuffle); else each task writes what it has."""
    spark = df.sparkSession
    write = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    path = os.path.join(root, DATA, name, write)
    out = df.withColumn(CELL, cell_of(key, n_cells))
    if grouped:
        out = out.repartition(F.col(CELL))
    out.write.partitionBy(CELL).parquet(path)
    # counts from the files' footers, one row per cell
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(CELL, T.IntegerType())])).parquet(path).groupBy(CELL).agg(F.count(F.lit(1)).alias("n")).collect()
    return write, {r[CELL]: (write, r["n"]) for r in rows}


def replace(df: DataFrame, root: str, name: str, key: tuple[str, ...], n_cells: int = DEFAULT_CELLS) -> Change:
    """``df`` as the whole table."""
    _, cells = write_cells(df, root, name, key, n_cells)
    return Change(name, Table(key, n_cells, df.schema, cells), whole=True, inserted=sum(n for _, n in cells.values()))


def cells_for(rows: int, least: int) -> int:
    """Cells of a table of so many rows: ``least``, doubled until a cell holds no more than ``CELL_ROWS``."""
    n = least
    while n * CELL_ROWS < rows:
        n *= 2
    return n


def touched_cells(df: DataFrame, columns: list[str], n_cells: int) -> set[int]:
    """Cells that the keys in ``columns`` fall into (at most ``n_cells`` numbers to the driver)."""
    return {r[0] for r in df.select(cell_of(columns, n_cells)).distinct().collect()}


def merge(
    batch: DataFrame,
    root: str,
    name: str,
    at: Snapshot,
    key: tuple[str, ...],
    n_keys: int | None = None,
    n_cells: int = DEFAULT_CELLS,
    n_rows: int | None = None,
) -> Change:
    """Upsert ``batch`` (one row per key, not recomputed by each use) into a table.

    Only cells that the batch's keys fall into are read and written. I11 comes
    without a pass of its own: rows of the new cells less those of the old
    ones are insertions, the rest of the batch updates."""
    spark = batch.sparkSession
    old = at.tables.get(name)
    if old is None:
        return replace(batch, root, name, key, n_cells)
    cells = touched_cells(batch, list(key), old.n_cells)
    columns = batch.columns
    base = read(spark, root, name, at, cells, old.schema).select(*columns)
    if n_keys is not None and n_keys <= BROADCAST_KEYS:
        # kept rows lie together by cell already; only the batch is dealt by cell
        dealt = batch.withColumn(CELL, cell_of(key, old.n_cells)).repartition(F.col(CELL)).drop(CELL)
        merged = upsert(base, dealt, list(key), n_keys)
        _, new = write_cells(merged, root, name, key, old.n_cells, grouped=False)
    else:
        # the join deals the kept rows by key: as they are, every task would write a file in every cell
        _, new = write_cells(upsert(base, batch, list(key), n_keys), root, name, key, old.n_cells)
    before = sum(old.cells[c][1] for c in cells if c in old.cells)
    inserted = sum(n for _, n in new.values()) - before
    total = batch.count() if n_rows is None else n_rows
    return Change(name, Table(key, old.n_cells, old.schema, new), inserted=inserted, updated=total - inserted)


def add(rows: DataFrame, root: str, name: str, at: Snapshot, key: tuple[str, ...], n_cells: int = DEFAULT_CELLS, sums: list[str] | None = None) -> Change | None:
    """Rows added to a table: one row per ``key`` with its ``sums`` added up, or, without sums, rows beside rows.

    Like :func:`merge` it reads and writes the cells of the keys only; None for no rows."""
    old = at.tables.get(name)
    n_cells = old.n_cells if old else n_cells
    cells = touched_cells(rows, list(key), n_cells)
    if not cells:
        return None
    columns = rows.columns
    both = rows if old is None else read(rows.sparkSession, root, name, at, cells, old.schema).select(*columns).unionByName(rows)
    if sums:
        both = both.groupBy(*key).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums]).select(*columns)
    _, new = write_cells(both, root, name, key, n_cells)
    return Change(name, Table(key, n_cells, old.schema if old else rows.schema, new), inserted=sum(n for _, n in new.values()))


def delta(at: Snapshot, root: str, batch: DataFrame, name: str, key: str, n_keys: int | None = None) -> DataFrame:
    """The rows of a table that a merge of ``batch`` would replace."""
    spark = batch.sparkSession
    old = at.tables[name]
    base = read(spark, root, name, at, touched_cells(batch, [key], old.n_cells), old.schema)
    keys = batch.select(key)
    return base.join(F.broadcast(keys) if n_keys is not None and n_keys <= BROADCAST_KEYS else keys, key, "left_semi")


def rebucket(spark: SparkSession, root: str, name: str, n_cells: int) -> Snapshot:
    """Deal a table that has grown into another number of cells."""

    def work(now: Snapshot) -> Work:
        t = now.tables[name]
        return Work([replace(read(spark, root, name, now), root, name, t.key, n_cells)])

    return transact(spark, root, work)[0]


def vacuum(spark: SparkSession, root: str, keep: int = 2, min_age_hours: float = 24.0) -> dict[str, int]:
    """Delete commits but the ``keep`` newest, and writes that those don't name.

    Writes younger than ``min_age_hours`` stay, as they may wait for their
    commit; readers of a version must be done in that time."""
    everything = versions(spark, root)
    kept = everything[-max(keep, 1) :]
    used = {(name, w) for v in kept for name, t in snapshot(spark, root, v).tables.items() for w, _ in t.cells.values()}
    horizon = (time.time() - min_age_hours * 3600) * 1000
    fs, _, jvm = _fs(spark, root)
    removed = {"versiones": 0, "escrituras": 0, "restos": 0}
    for v in everything[: len(everything) - len(kept)]:
        removed["versiones"] += bool(fs.delete(jvm.org.apache.hadoop.fs.Path(os.path.join(root, COMMITS, f"{version_id(v)}.json")), False))
    for name in list_names(spark, os.path.join(root, DATA)):
        folder = os.path.join(root, DATA, name)
        for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
            if (name, st.getPath().getName()) not in used and st.getModificationTime() < horizon:
                removed["escrituras"] += bool(fs.delete(st.getPath(), True))
    # what jobs that died left behind
    for folder, prefix in ((STAGED, ""), (COMMITS, "_borrador-")):
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(root, folder))
        for st in fs.listStatus(p) if fs.exists(p) else []:
            if st.getPath().getName().startswith(prefix) and st.getModificationTime() < horizon:
                removed["restos"] += bool(fs.delete(st.getPath(), True))
    return removed
