import os

import pytest
from datetime import datetime

from pyspark.sql import functions as F

from cohorte.schemas import PREDICTION_LOG
from cohorte.sources.store import latest
from cohorte.sources.tables import list_versions, read_latest, version_id, write_version
from cohorte.streaming.monitor import start_monitor_stream, window_metrics
from cohorte.streaming.uploads import _merge_batch, landing_schema, start_upload_stream


def _patients(spark, rows):
    return spark.createDataFrame(rows, landing_schema("paciente"))


def test_upload_stream_and_redelivery(spark, scratch):
    rows = [("P1", "F", "40", None, "2020-01-05", "Mama", "I", "X", "si", 1),
            ("P2", "M", "50", "Rural", "2020-01-06", "Colon", "II", "Y", "no", 2)]
    landing = os.path.join(scratch, "landing")
    _patients(spark, rows).coalesce(1).write.option("header", True).csv(landing)
    tables = os.path.join(scratch, "tablas")
    q = start_upload_stream(spark, "paciente", landing, tables, os.path.join(scratch, "chk"), available_now=True)
    q.awaitTermination()
    first = sorted(map(tuple, read_latest(spark, tables, "paciente").collect()))
    assert [r[0] for r in first] == ["P1", "P2"]
    # the same micro-batch delivered again (e.g. after a failure) leaves the same table
    merge = _merge_batch(spark, "paciente", tables, "_fila", os.path.join(scratch, "chk"))
    batch = _patients(spark, rows)
    merge(batch, 0)
    merge(batch, 0)
    assert sorted(map(tuple, read_latest(spark, tables, "paciente").collect())) == first
    assert len(list_versions(spark, tables, "paciente")) == 1


@pytest.mark.parametrize("threshold", ["-1", "64m"])
def test_redelivery_on_a_large_base_and_shared_store(spark, scratch, threshold):
    """A batch on a table much larger than itself, written by a batch job before; twice; with and without broadcast joins."""
    base = spark.range(200_000).selectExpr(
        "concat('P', id) AS id_paciente", "'F' AS sexo", "40 AS edad", "'x' AS zona_residencia", "DATE'2020-01-01' AS fecha_dx",
        "'Mama' AS tipo_cancer", "'I' AS estadio", "'X' AS aseguradora", "true AS adherencia_12m",
    )
    tables = os.path.join(scratch, "tablas")
    write_version(base, tables, "paciente", version_id(7))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        merge = _merge_batch(spark, "paciente", tables, "_fila", "s1")
        batch = _patients(spark, [(f"N{i}", "F", "40", None, "2020-01-05", "Mama", "I", "X", "si", i) for i in range(10)])
        for batch_id in (0, 0, 1):
            merge(batch, batch_id)
            assert read_latest(spark, tables, "paciente").count() == 200_010
        assert list_versions(spark, tables, "paciente") == [version_id(i) for i in (7, 8, 9)]
        # a stream with a checkpoint of its own, and a batch of bad rows only
        other = _merge_batch(spark, "paciente", tables, "_fila", "s2")
        other(_patients(spark, [(None, None, "x", None, "never", None, None, None, None, 0)] * 3), 0)
        assert read_latest(spark, tables, "paciente").count() == 200_010
        last = latest(spark, tables)
        assert last.version == 10 and spark.read.parquet(os.path.join(tables, last.info["errores"])).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _log_rows(spark, times):
    rows = [(datetime(2024, 1, 1, *t), f"r{i}", "v1", 1, 0.9, 5.0, True, None, None) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, PREDICTION_LOG)


def test_window_metrics_batch(spark):
    m = window_metrics(_log_rows(spark, [(10, 0), (10, 1), (10, 7)])).orderBy("ventana").collect()
    assert [r["solicitudes"] for r in m] == [2, 1]
    assert m[0]["tasa_exito"] == 1.0 and m[0]["latencia_mediana_ms"] == 5.0


def test_monitor_drops_late_rows(spark, scratch):
    log = os.path.join(scratch, "log")
    # Spark judges lateness against the watermark of the previous batch, so
    # the late row comes two batches after the one that moved the watermark
    for i, times in enumerate([[(10, 0), (10, 2)], [(10, 31)], [(10, 40)], [(9, 50)]]):
        _log_rows(spark, times).coalesce(1).write.mode("overwrite").json(os.path.join(log, f"b{i}"))
    out = os.path.join(scratch, "out")
    q = start_monitor_stream(spark, log, out, os.path.join(scratch, "chk"), watermark="10 minutes", available_now=True,
                             max_files_per_trigger=1)
    q.awaitTermination()
    got = {r["inicio"].time().isoformat(): r["solicitudes"] for r in spark.read.parquet(out).collect()}
    assert "09:50:00" not in got  # later than the watermark: dropped
    assert got.get("10:00:00") in (None, 2)  # emitted once the watermark passed 10:05


def test_monitor_stream_equals_batch_on_in_order_input(spark, scratch):
    log = os.path.join(scratch, "log")
    batches = [[(10, 0), (10, 1)], [(10, 6), (10, 7)], [(10, 12)]]
    for i, times in enumerate(batches):
        _log_rows(spark, times).coalesce(1).write.mode("overwrite").json(os.path.join(log, f"b{i}"))
    out = os.path.join(scratch, "out")
    q = start_monitor_stream(spark, log, out, os.path.join(scratch, "chk"), available_now=True,
                             output_mode="complete", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = sorted((r["inicio"], r["solicitudes"], r["tasa_exito"]) for r in spark.read.parquet(out).collect())
    all_rows = _log_rows(spark, [t for b in batches for t in b])
    batch = sorted((r["ventana"]["start"], r["solicitudes"], r["tasa_exito"]) for r in window_metrics(all_rows).collect())
    assert streamed == batch


def test_scoring_stream_equals_batch(spark, scratch):
    from cohorte.plans.catalog_ml import feature_table
    from cohorte.plans.scoring import score_requests
    from cohorte.plans.training import train
    from cohorte.streaming.scoring import REQUEST_SCHEMA, start_scoring_stream

    f = feature_table(spark, "/root/testdata/sf0.001").withColumn("tipo_modelo", F.lit("neural_network"))
    model = train(f, "neural_network").model
    reqs = f.select(*[c.name for c in REQUEST_SCHEMA.fields])
    reqs.repartition(3).write.json(os.path.join(scratch, "req"))
    q = start_scoring_stream(spark, model, "v1", os.path.join(scratch, "req"), os.path.join(scratch, "log"),
                             os.path.join(scratch, "chk"), available_now=True)
    q.awaitTermination()
    streamed = spark.read.schema(PREDICTION_LOG).option("recursiveFileLookup", True).json(os.path.join(scratch, "log"))
    key = lambda r: (r["success"], r["prediction"], round(r["probability"], 9))
    batch = score_requests(model, reqs, "v1")
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))
    assert streamed.where("inference_time_ms IS NULL").count() == 0
