import os
import threading

import pytest
from pyspark.sql import functions as F

from cohorte.plans.ingest import deliver
from cohorte.sources import store as S
from cohorte.sources.tables import list_versions, read_all, read_latest
from cohorte.streaming.uploads import landing_schema

KV = "k string, v long"


def kv(spark, pairs):
    return spark.createDataFrame(list(pairs), KV)


def put(spark, root, pairs, stream=None, n_cells=8):
    rows = kv(spark, pairs)
    return S.transact(spark, root, lambda at: S.Work([S.merge(rows, root, "t", at, ("k",), rows.count(), n_cells)]), stream)


def content(spark, root, version=None):
    at = S.latest(spark, root) if version is None else S.snapshot(spark, root, version)
    return {r["k"]: r["v"] for r in S.read(spark, root, "t", at).collect()}


def files(root, name):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(os.path.join(root, "datos", name)) for f in fs if f.endswith(".parquet")}


def patients(spark, n, start=0):
    return spark.range(start, start + n).selectExpr(
        "concat('P', id) AS id_paciente", "'F' AS sexo", "'40' AS edad", "'x' AS zona_residencia", "'2020-01-01' AS fecha_dx",
        "'Mama' AS tipo_cancer", "'I' AS estadio", "'X' AS aseguradora", "'si' AS adherencia_12m", "id AS _fila",
    )


def test_small_batch_writes_only_its_cells(spark, scratch):
    deliver(spark, scratch, {"paciente": patients(spark, 200_000)}, n_cells=64)
    first = S.latest(spark, scratch)
    assert len(first.tables["paciente"].cells) == 64 and first.tables["paciente"].rows == 200_000
    before = files(scratch, "paciente")
    batch = patients(spark, 5).unionByName(patients(spark, 5, 900_000)).withColumn("edad", F.lit("41"))
    res = deliver(spark, scratch, {"paciente": batch}, n_cells=64)
    assert res.stats == {"paciente": {"insertados": 5, "actualizados": 5, "errores": 0}}
    second = S.latest(spark, scratch)
    moved = {c for c, w in second.tables["paciente"].cells.items() if w != first.tables["paciente"].cells.get(c)}
    assert 0 < len(moved) <= 10
    written = files(scratch, "paciente") - before
    assert {int(f.split("_celda=")[1].split("/")[0]) for f in written} == moved
    now = read_latest(spark, scratch, "paciente")
    assert now.count() == 200_005 and now.where("edad = 41").count() == 10
    # the version before is still whole
    assert S.read(spark, scratch, "paciente", first).where("edad = 41").count() == 0


def test_second_publisher_of_a_version_fails(spark, scratch):
    put(spark, scratch, [("a", 1)])
    at = S.latest(spark, scratch)
    S.commit(spark, scratch, S.Snapshot(at.version + 1, at.tables))
    with pytest.raises(S.Conflict):
        S.commit(spark, scratch, S.Snapshot(at.version + 1, at.tables))
    assert not [n for n in S.list_names(spark, os.path.join(scratch, "_commits")) if n.startswith("_")]


def test_publish_takes_a_name_once(spark, scratch):
    for i in (1, 2):
        os.makedirs(f"{scratch}/draft{i}")
        open(f"{scratch}/draft{i}/f{i}", "w").close()
    assert S.publish(spark, f"{scratch}/draft1", f"{scratch}/name")
    assert not S.publish(spark, f"{scratch}/draft2", f"{scratch}/name")
    assert os.listdir(f"{scratch}/name") == ["f1"]


@pytest.mark.parametrize("same_cell", [True, False])
def test_race_loses_no_update(spark, scratch, same_cell):
    """Another writer commits between reading and committing."""
    put(spark, scratch, ((f"k{i}", 0) for i in range(50)))
    cell = {r["k"]: r["c"] for r in S.read(spark, scratch, "t", S.latest(spark, scratch)).select("k", S.cell_of(["k"], 8).alias("c")).collect()}
    other = next(k for k in cell if k != "k0" and (cell[k] == cell["k0"]) == same_cell)
    runs = []

    def work(at):
        runs.append(at.version)
        rows = kv(spark, [("k0", 1)])
        change = S.merge(rows, scratch, "t", at, ("k",), 1, 8)
        if len(runs) == 1:
            put(spark, scratch, [(other, 2)])
        return S.Work([change])

    at, _ = S.transact(spark, scratch, work)
    assert at.version == 3 and len(runs) == (2 if same_cell else 1)
    got = content(spark, scratch)
    assert (got["k0"], got[other], len(got)) == (1, 2, 50)


def test_work_that_read_a_changed_cell_runs_again(spark, scratch):
    put(spark, scratch, [("a", 1)])
    runs = []

    def work(at):
        runs.append(at.version)
        total = S.read(spark, scratch, "t", at).agg(F.sum("v")).first()[0]
        if len(runs) == 1:
            put(spark, scratch, [("b", 10)])
        return S.Work([S.replace(spark.createDataFrame([(total,)], "total long"), scratch, "sum", ("total",), 1)], {"t": None})

    at, _ = S.transact(spark, scratch, work)
    assert runs == [1, 2]
    assert S.read(spark, scratch, "sum", at).first()[0] == 11


def test_many_writers_at_once(spark, scratch):
    put(spark, scratch, [("start", 0)])
    problems = []

    def writer(i):
        try:
            put(spark, scratch, [(f"w{i}", i), ("shared", i)], ("s%d" % i, 0))
        except Exception as e:  # noqa: BLE001
            problems.append(e)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems
    got = content(spark, scratch)
    assert {f"w{i}": i for i in range(4)}.items() <= got.items() and got["shared"] in range(4)
    assert S.versions(spark, scratch) == [1, 2, 3, 4, 5]


def test_a_stream_batch_counts_once(spark, scratch):
    put(spark, scratch, [("a", 1)], ("s", 0))
    put(spark, scratch, [("a", 2)], ("s", 1))
    at, done = put(spark, scratch, [("a", 1)], ("s", 0))
    assert done is None and at.version == 2 and content(spark, scratch) == {"a": 2}
    put(spark, scratch, [("a", 3)], ("other", 0))
    assert content(spark, scratch) == {"a": 3}


def test_crash_between_tables_leaves_all_three(spark, scratch, monkeypatch):
    c = spark.createDataFrame([("C1", "2020-02-01", "Control", "Alta", "E1", "P1", 1)], landing_schema("consulta"))
    lab = spark.createDataFrame([("L1", "2020-02-01", "PSA", None, "1.5", None, "P1", 1)], landing_schema("laboratorio"))
    sheets = {"paciente": patients(spark, 3), "consulta": c, "laboratorio": lab}
    deliver(spark, scratch, sheets, n_cells=4)
    before = {n: sorted(map(tuple, t.collect())) for n, t in read_all(spark, scratch).items()}
    real = S.merge
    staged = len(S.list_names(spark, os.path.join(scratch, "_preparado")))

    def dies(batch, root, name, *args, **kwargs):
        if name == "consulta":
            raise RuntimeError("killed")
        return real(batch, root, name, *args, **kwargs)

    monkeypatch.setattr(S, "merge", dies)
    with pytest.raises(RuntimeError, match="killed"):
        deliver(spark, scratch, {**sheets, "paciente": patients(spark, 5).withColumn("edad", F.lit("50"))}, n_cells=4)
    monkeypatch.setattr(S, "merge", real)
    assert {n: sorted(map(tuple, t.collect())) for n, t in read_all(spark, scratch).items()} == before
    deliver(spark, scratch, {**sheets, "paciente": patients(spark, 5).withColumn("edad", F.lit("50"))}, n_cells=4)
    assert read_latest(spark, scratch, "paciente").where("edad = 50").count() == 5
    assert staged == 0 and S.vacuum(spark, scratch, min_age_hours=-1)["restos"] == 1  # the killed delivery's
    assert read_latest(spark, scratch, "paciente").where("edad = 50").count() == 5
    assert list_versions(spark, scratch, "paciente") == [S.version_id(1), S.version_id(2)]


def test_children_see_patients_of_other_cells_and_this_delivery(spark, scratch):
    deliver(spark, scratch, {"paciente": patients(spark, 50)}, n_cells=8)
    visits = [(f"C{i}", "2020-02-01", "Control", "Alta", "E1", f"P{i}", i) for i in range(60)]
    res = deliver(spark, scratch, {"paciente": patients(spark, 2, 50), "consulta": spark.createDataFrame(visits, landing_schema("consulta"))}, n_cells=8)
    assert res.stats["consulta"] == {"insertados": 52, "actualizados": 0, "errores": 8}
    assert {r["clave"] for r in res.errors().collect()} == {f"C{i}" for i in range(52, 60)}


def test_vacuum_and_rebucket(spark, scratch):
    for v in range(4):
        put(spark, scratch, ((f"k{i}", v) for i in range(20)))
    put(spark, scratch, [("k0", 9)])
    S.rebucket(spark, scratch, "t", 3)
    want = {f"k{i}": 3 for i in range(20)} | {"k0": 9}
    assert content(spark, scratch) == want and S.latest(spark, scratch).tables["t"].n_cells == 3
    assert S.vacuum(spark, scratch, keep=1)["escrituras"] == 0  # too young to go
    assert S.vacuum(spark, scratch, keep=1, min_age_hours=-1)["escrituras"] == 5
    assert content(spark, scratch) == want and S.versions(spark, scratch) == [6]
    put(spark, scratch, [("new", 1)])
    assert content(spark, scratch) == want | {"new": 1}


def test_a_large_merge_writes_one_file_a_cell(spark, scratch):
    put(spark, scratch, [(f"k{i}", i) for i in range(400)], n_cells=4)
    rows = spark.createDataFrame([(f"k{i}", -i) for i in range(200, 600)], "k string, v long").repartition(8)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        S.transact(spark, scratch, lambda at: S.Work([S.merge(rows, scratch, "t", at, ("k",), 10**9, 4)]))
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    t = S.latest(spark, scratch).tables["t"]
    files = [f for c, (w, _) in t.cells.items() for f in os.listdir(os.path.join(scratch, S.DATA, "t", w, f"{S.CELL}={c}")) if f.endswith(".parquet")]
    assert len(files) == len(t.cells) == 4
    assert {(r[0], r[1]) for r in S.read(spark, scratch, "t", S.latest(spark, scratch)).collect()} == {(f"k{i}", i if i < 200 else -i) for i in range(600)}


def test_cells_grow_with_the_first_rows():
    assert [S.cells_for(n, 8) for n in (0, 8 * S.CELL_ROWS, 8 * S.CELL_ROWS + 1, 100 * S.CELL_ROWS)] == [8, 8, 16, 128]


def test_a_sheet_of_one_part_is_parsed_by_all_cores(spark):
    from cohorte.plans.ingest import _dealt

    cores = spark.sparkContext.defaultParallelism
    assert _dealt(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores + 3)
    assert _dealt(wide) is wide
