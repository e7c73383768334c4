import os

import pytest

from cohorte.operators.clean import fill_residual_missing
from cohorte.operators.encode import hash_bucket
from cohorte.plans.catalog_ml import feature_table
from cohorte.plans.training import train
from cohorte.schemas import FEATURES
from cohorte.sources.fixtures import raw_sheets
from cohorte.sources.registry import version_from_path
from cohorte.sources.tables import create_tables, drop_tables, latest_feature_csv, load_sheets, write_feature_csv

SF = "/root/testdata/sf0.001"


def test_load_sheets_and_missing_sheet(spark, scratch):
    sheets = raw_sheets(spark, SF)
    for name, df in sheets.items():
        df.drop("_fila").write.option("header", True).csv(os.path.join(scratch, "upload", name))
    loaded = load_sheets(spark, os.path.join(scratch, "upload"))
    assert {n: df.count() for n, df in loaded.items()} == {n: df.count() for n, df in sheets.items()}
    os.makedirs(os.path.join(scratch, "partial", "paciente"))
    with pytest.raises(ValueError):
        load_sheets(spark, os.path.join(scratch, "partial"))


def test_feature_csv_sink_and_latest(spark, scratch):
    f = feature_table(spark, SF)
    with pytest.warns(UserWarning, match="edad"):
        out = write_feature_csv(f, scratch, "20240101_000000")
    assert out["total_registros"] == f.count()
    assert out["faltantes_reemplazados"] == {"edad": f.where("edad IS NULL").count()}
    write_feature_csv(f.limit(3), scratch, "20240102_000000")
    latest = latest_feature_csv(spark, scratch, FEATURES)
    assert latest.count() == 3 and latest.columns == FEATURES.fieldNames()
    with pytest.raises(FileNotFoundError):
        latest_feature_csv(spark, os.path.join(scratch, "none"), FEATURES)


def test_ddl(spark, scratch):
    create_tables(spark, scratch)
    assert spark.table("laboratorio").schema["resultado_numerico"].dataType.typeName() == "double"
    drop_tables(spark)


def test_residual_fill(spark):
    df = spark.createDataFrame([(float("nan"), None, "a"), (1.5, 2, "b")], "x double, n long, t string")
    assert [tuple(r) for r in fill_residual_missing(df).collect()] == [(0.0, 0, "a"), (1.5, 2, "b")]


def test_hash_bucket_and_version(spark):
    df = spark.createDataFrame([("Mama",), ("Mama",), ("Colon",)], "c string")
    b = [r[0] for r in df.select(hash_bucket("c")).collect()]
    assert b[0] == b[1] and all(0 <= x < 100 for x in b)
    p = spark.createDataFrame([("/m/xgboost/v20240101_000000_000000",), ("/m/legacy_model/",)], "path string")
    assert [r[0] for r in p.select(version_from_path()).collect()] == ["v20240101_000000_000000", "legacy_model"]


def test_minimum_size_guard(spark):
    with pytest.raises(ValueError):
        train(feature_table(spark, SF).limit(5), "neural_network")


def test_jdbc_bucket_predicates_cover_every_row():
    import duckdb

    from cohorte.sources.jdbc import bucket_predicates

    preds = bucket_predicates("id_paciente", 4, hash_sql="hash({key})")
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 'P' || i AS id_paciente FROM range(1000) r(i)")
    counts = [con.execute(f"SELECT COUNT(*) FROM t WHERE {p}").fetchall()[0][0] for p in preds]
    assert sum(counts) == 1000 and all(c > 0 for c in counts)
