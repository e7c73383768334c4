"""The prediction log, its windows and its live quality: every row once, whatever is delivered again or late."""

import os
from datetime import datetime, timedelta

import pytest

from cohorte.schemas import PREDICTION_LOG
from cohorte.sources import logs as L
from cohorte.sources import store as S
from cohorte.streaming import monitor as M
from cohorte.streaming import quality as Q

T0 = datetime(2024, 1, 1, 10, 0)


def row(minutes, rid, version="v1", prediction=1, ok=True):
    return (T0 + timedelta(minutes=minutes), rid, version, prediction if ok else -1, 0.75 if ok else 0.0, 4.0, ok, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, PREDICTION_LOG)


def ids(df):
    return sorted(r["request_id"] for r in df.select("request_id").collect())


# -- log -------------------------------------------------------------------------


def test_streams_share_a_log_and_replays_add_nothing(spark, scratch):
    for stream in ("chk-a", "chk-b"):
        for batch in (0, 1):
            assert L.append_log(frame(spark, [row(batch, f"{stream}-{batch}")]), scratch, L.stream_batch(stream, batch))
            assert not L.append_log(frame(spark, [row(batch, "again")]), scratch, L.stream_batch(stream, batch))
    assert ids(L.read_log(spark, scratch)) == ["chk-a-0", "chk-a-1", "chk-b-0", "chk-b-1"]
    assert not [n for n in os.listdir(scratch) if n.startswith("_")]


def test_a_batch_of_a_killed_writer_is_invisible(spark, scratch, monkeypatch):
    L.append_log(frame(spark, [row(0, "a")]), scratch)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(L, "publish", killed)
    with pytest.raises(RuntimeError):
        L.append_log(frame(spark, [row(1, "b")]), scratch, "s-x-1")
    monkeypatch.undo()
    assert ids(L.read_log(spark, scratch)) == ["a"]
    assert L.append_log(frame(spark, [row(1, "b")]), scratch, "s-x-1")
    assert L.vacuum_log(spark, scratch, min_age_hours=-1) == 1  # the draft
    assert ids(L.read_log(spark, scratch)) == ["a", "b"]


def test_compaction(spark, scratch):
    want = []
    for i in range(6):
        rows = [row(i * 700 + k, f"r{i}{k}") for k in range(3)]  # over several days
        want += [r[1] for r in rows]
        L.append_log(frame(spark, rows).repartition(3), scratch, f"s-x-{i}")
    before = sorted(map(tuple, L.read_log(spark, scratch).select("timestamp", "request_id", "fecha").collect()))
    done = L.compact_log(spark, scratch)
    assert done["lotes"] == 6 and 0 < done["archivos"] <= 6
    assert sorted(map(tuple, L.read_log(spark, scratch).select("timestamp", "request_id", "fecha").collect())) == before
    # what was replaced can go; a replay still finds its batch; new batches come on top, and are compacted again
    assert L.vacuum_log(spark, scratch) == 0 and L.vacuum_log(spark, scratch, min_age_hours=-1) == 6
    assert not L.append_log(frame(spark, [row(0, "again")]), scratch, "s-x-3")
    for i in (6, 7):
        L.append_log(frame(spark, [row(0, f"n{i}")]), scratch, f"s-x-{i}")
    assert L.compact_log(spark, scratch)["lotes"] == 2
    L.append_log(frame(spark, [row(0, "last")]), scratch)
    assert ids(L.read_log(spark, scratch)) == sorted([*want, "n6", "n7", "last"])
    assert L.compact_log(spark, scratch) == {"lotes": 0, "archivos": 0}


def test_compaction_leaves_malformed_lines_where_they_are(spark, scratch):
    for i in range(3):
        L.append_log(frame(spark, [row(i, f"r{i}")]), scratch, f"b-{i}")
    with open(f"{scratch}/lote=b-1/fecha=2024-01-01/x.json", "w") as f:
        f.write("{broken\n")
    assert L.compact_log(spark, scratch)["lotes"] == 2
    assert ids(L.read_log(spark, scratch)) == ["r0", "r1", "r2"] and L.malformed_count(spark, scratch) == 1


def test_of_two_compactions_one_wins(spark, scratch, monkeypatch):
    for i in range(3):
        L.append_log(frame(spark, [row(i, f"r{i}")]), scratch, f"b-{i}")
    stale = L._compacted(spark, scratch)
    assert L.compact_log(spark, scratch)["lotes"] == 3
    monkeypatch.setattr(L, "_compacted", lambda *_: stale)  # one that began before
    assert L.compact_log(spark, scratch) == {"lotes": 0, "archivos": 0}
    monkeypatch.undo()
    assert ids(L.read_log(spark, scratch)) == ["r0", "r1", "r2"]


# -- windows and sessions ----------------------------------------------------------


def test_late_rows_are_kept(spark, scratch):
    log, out, chk = (os.path.join(scratch, d) for d in ("log", "out", "chk"))
    run = lambda: M.start_window_stream(spark, log, out, chk, available_now=True, n_cells=2).awaitTermination()
    L.append_log(frame(spark, [row(0, "a"), row(1, "b", ok=False), row(31, "c")]), log)
    run()
    # the watermark is 10:21: windows up to 10:20 are closed
    L.append_log(frame(spark, [row(2, "late"), row(14.9, "late too"), row(22, "open"), row(16, "late", "v2")]), log)
    run()
    assert ids(M.late_rows(spark, out)) == ["late", "late", "late too"]
    got = {(r.inicio.minute, r.model_version): (r.solicitudes, r.con_exito, r.cerrada) for r in M.windows(spark, out).collect()}
    assert got == {(0, "v1"): (2, 1, True), (20, "v1"): (1, 1, False), (30, "v1"): (1, 1, False)}
    # delivered again
    M._add_batch(out, os.path.abspath(chk), 300_000, 600_000, 2)(frame(spark, [row(40, "x")]), 1)
    assert M.windows(spark, out).count() == 3 and S.latest(spark, out).version == 2


def test_windows_equal_those_of_the_batch_form(spark, scratch):
    log, out, chk = (os.path.join(scratch, d) for d in ("log", "out", "chk"))
    rows = [row(i * 0.7, f"r{i}", f"v{i % 2}", int(i % 3 == 0), i % 5 > 0) for i in range(200)]
    for i in range(0, 200, 50):
        L.append_log(frame(spark, rows[i : i + 50]).coalesce(1), log)
        M.start_window_stream(spark, log, out, chk, available_now=True, n_cells=2).awaitTermination()
    assert M.late_rows(spark, out).count() == 0
    batch = {(r.ventana.start, r.model_version): (r.solicitudes, round(r.tasa_exito, 9), round(r.probabilidad_media, 9)) for r in M.window_metrics(frame(spark, rows)).collect()}
    got = {(r.inicio, r.model_version): (r.solicitudes, round(r.con_exito / r.solicitudes, 9), round(r.suma_probabilidad / r.con_exito, 9)) for r in M.windows(spark, out).collect()}
    assert got == batch


def test_sessions(spark, scratch):
    log, out, chk = (os.path.join(scratch, d) for d in ("log", "out", "chk"))
    rows = [row(m, f"r{m}") for m in (0, 2, 4, 20, 21)] + [row(3, "other", "v2")]
    batch = sorted(map(tuple, M.session_activity(frame(spark, rows)).collect()))
    assert [(r[0].minute, r[1].minute, r[3]) for r in batch] == [(0, 4, 3), (3, 3, 1), (20, 21, 2)]
    L.append_log(frame(spark, rows), log)
    for _ in range(2):
        M.start_session_stream(spark, log, out, chk, available_now=True).awaitTermination()
        L.append_log(frame(spark, [row(600, "clock", "clock")]), log)
    M.start_session_stream(spark, log, out, chk, available_now=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == batch


# -- live quality --------------------------------------------------------------------


def test_labels_in_time_late_and_never(spark, scratch):
    log, labels, out, chk = (os.path.join(scratch, d) for d in ("log", "labels", "out", "chk"))

    def run(rows, known, n):
        L.append_log(frame(spark, rows), log)
        spark.createDataFrame([(i, T0 + timedelta(minutes=m), y) for i, m, y in known], Q.LABELS).write.json(os.path.join(labels, str(n)))
        Q.start_quality_stream(spark, log, labels, out, chk, label_delay="60 minutes", watermark="10 minutes", available_now=True).awaitTermination()

    run([row(0, "in time"), row(1, "too late"), row(2, "never"), row(3, "failed", ok=False), row(4, "before")], [("before", 3, 1), ("in time", 30, 1)], 1)
    run([row(500, "clock")], [("too late", 62, 0), ("clock label", 500, 0)], 2)
    run([row(900, "clock 2")], [("never", 20, 1), ("clock label 2", 900, 0)], 3)
    got = {r.request_id: r.etiqueta for r in spark.read.parquet(out).collect()}
    # a label that comes after the watermark finds its prediction given out: once, without
    assert got == {"in time": 1, "too late": None, "never": None, "before": None, "clock": None}
    q = Q.quality(spark.read.parquet(out).where("request_id NOT LIKE 'clock%'")).first()
    assert (q.n, q.sin_etiqueta, q.accuracy, q.alerta_accuracy) == (1, 3, 1.0, False)


def test_stream_equals_batch_on_input_in_order(spark, scratch):
    log, labels, out, chk = (os.path.join(scratch, d) for d in ("log", "labels", "out", "chk"))
    rows = [row(i, f"r{i}", prediction=i % 2) for i in range(60)]
    known = [(f"r{i}", T0 + timedelta(minutes=i + 5), int(i % 3 == 0)) for i in range(60)]
    y = spark.createDataFrame(known, Q.LABELS)
    for a in range(0, 60, 20):
        L.append_log(frame(spark, rows[a : a + 20]), log)
        spark.createDataFrame(known[a : a + 20], Q.LABELS).write.json(os.path.join(labels, str(a)))
        Q.start_quality_stream(spark, log, labels, out, chk, label_delay="60 minutes", available_now=True).awaitTermination()
    batch = Q.quality(Q.joined_labels(frame(spark, rows), y, "60 minutes", "10 minutes")).first()
    assert Q.quality(spark.read.parquet(out)).first() == batch
    by = Q.quality(spark.read.parquet(out), by=["model_version"]).collect()
    assert len(by) == 1 and by[0].n == 60
