import os
from datetime import datetime

from pyspark.sql import functions as F

from cohorte.operators.encode import LabelVocabulary
from cohorte.operators.scale import PopulationScaler
from cohorte.operators.split import assign_split
from cohorte.plans.catalog_ml import feature_table
from cohorte.plans.kpis import rollback_decision
from cohorte.plans.scoring import score_requests
from cohorte.plans.training import build_pipeline, train
from cohorte.sources.logs import append_log, last_predictions, malformed_count, read_log
from cohorte.sources.registry import load_latest, new_version, save_model

SF = "/root/testdata/sf0.001"


def test_vocabulary_unknown_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "z string")
    model = LabelVocabulary(inputCols=["z"]).fit(train)
    assert model.get_vocabularies() == {"z": ["a", "b", "c"]}
    test = spark.createDataFrame([("c",), ("zz",), (None,)], "z string")
    assert [r[0] for r in model.transform(test).select("z_encoded").collect()] == [2, 0, 0]


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (7.0,)], "x double")
    m = PopulationScaler(inputCols=["x"]).fit(df)
    mean, std = m.get_stats()["x"]
    assert mean == 4.0 and abs(std - 5.0 ** 0.5) < 1e-12  # population, not sample
    const = PopulationScaler(inputCols=["x"]).fit(spark.createDataFrame([(2.0,), (2.0,)], "x double"))
    assert [r[0] for r in const.transform(spark.createDataFrame([(2.0,)], "x double")).collect()] == [0.0]


def test_split_is_repeatable_and_proportional(spark):
    f = feature_table(spark, SF)
    a = {r[0]: r[1] for r in assign_split(f.select("id_paciente"), "id_paciente").collect()}
    b = {r[0]: r[1] for r in assign_split(f.select("id_paciente"), "id_paciente").collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.1 < share < 0.3


def test_unknown_model_type(spark):
    import pytest

    with pytest.raises(ValueError):
        build_pipeline("random_forest")


def test_train_register_score_log(spark, scratch):
    f = feature_table(spark, SF)
    res = train(f, "neural_network")
    assert res.train_rows + res.test_rows == f.count()
    for part in (res.metrics_train, res.metrics_test):
        assert 0.0 <= part["accuracy"] <= 1.0
    root = os.path.join(scratch, "models")
    v1 = new_version(datetime(2024, 1, 1))
    v2 = new_version(datetime(2024, 1, 2))
    save_model(spark, root, res.model, dict(res.record(v1), trained_at=datetime(2024, 1, 1)))
    save_model(spark, root, res.model, dict(res.record(v2), trained_at=datetime(2024, 1, 2)))
    model, entry = load_latest(spark, root, "neural_network")
    assert entry["version"] == v2
    reqs = f.withColumn("tipo_modelo", F.when(F.col("count_consultas") == 0, F.lit("svm")).otherwise(F.lit("neural_network")))
    rows = score_requests(model, reqs, v2, at=datetime(2024, 3, 1))
    bad = rows.where(~F.col("success")).collect()
    assert bad and all(r["prediction"] == -1 and r["probability"] == 0.0 for r in bad)
    good = rows.where("success").collect()
    assert all(r["prediction"] in (0, 1) and 0.0 <= r["probability"] <= 1.0 for r in good)
    log = os.path.join(scratch, "log")
    append_log(rows, log)
    os.makedirs(os.path.join(log, "fecha=2024-03-01"))  # a day as logs without batches have it
    with open(os.path.join(log, "fecha=2024-03-01", "zz-malformed.json"), "w") as fh:
        fh.write("{not json\n\n")
    back = read_log(spark, log)
    assert back.count() == rows.count()
    assert malformed_count(spark, log) == 1
    assert last_predictions(back, 5).count() == 5


def test_gbt_trains(spark):
    res = train(feature_table(spark, SF), "xgboost")
    assert res.metrics_test["n"] == res.test_rows and res.train_seconds > 0


def test_rollback_decision(spark):
    rows = [
        ("xgboost", "v1", datetime(2024, 1, 1), {"test_f1_score": 0.80}),
        ("xgboost", "v2", datetime(2024, 2, 1), {"test_f1_score": 0.70}),   # < 0.95 * 0.80 -> roll back
        ("neural_network", "v1", datetime(2024, 1, 1), {"test_f1_score": 0.60}),
        ("neural_network", "v2", datetime(2024, 2, 1), {"test_f1_score": 0.59}),  # within 95 %
    ]
    reg = spark.createDataFrame(rows, "model_type string, version string, trained_at timestamp, metrics map<string,double>")
    got = {r["model_type"]: (r["revertir"], r["version_servida"]) for r in rollback_decision(reg).collect()}
    assert got == {"xgboost": (True, "v1"), "neural_network": (False, "v2")}


def test_drift_against_log(spark):
    from cohorte.plans.kpis import drift_against_log
    from cohorte.plans.training import prepare

    f = prepare(feature_table(spark, SF))
    res = train(feature_table(spark, SF), "neural_network")
    log = score_requests(res.model, f.withColumn("tipo_modelo", F.lit("neural_network")), "v1", at=datetime(2024, 1, 1))
    psi = {r["campo"]: r["psi"] for r in drift_against_log(f, log, ["edad", "count_consultas"]).collect()}
    assert set(psi) == {"edad", "count_consultas"}
    assert all(abs(v) < 1e-9 for v in psi.values())  # same population: no drift
    shifted = log.withColumn("input_features", F.col("input_features").withField("edad", F.col("input_features.edad") + 40))
    assert {r["campo"]: r["psi"] for r in drift_against_log(f, shifted, ["edad"]).collect()}["edad"] > 1.0


def test_prepared_rows_lie_evenly_over_the_cores(spark):
    from cohorte.plans import training as T

    n = 3 * T.LEAST_ROWS
    rows = spark.range(0, n, 1, 1).selectExpr(
        "concat('P', id) AS id_paciente", "'F' AS sexo", "CAST(id % 80 AS INT) AS edad", "'urbana' AS zona_residencia", "'mama' AS tipo_cancer",
        *[f"CAST(id % {i + 7} AS DOUBLE) AS {c}" for i, c in enumerate(T.NUMERIC_FEATURES) if c != "edad"], "CAST(id % 2 AS INT) AS adherencia_12m",
    )
    cores = spark.sparkContext.defaultParallelism
    sizes = T.prepared(rows).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == min(cores, 3) and sizes.sum() == n and sizes.max() < 1.1 * n / len(sizes)


def test_tasks_of_a_fit_grow_with_the_rows():
    from cohorte.plans.training import LEAST_ROWS, MOST_ROWS, fit_tasks

    assert [fit_tasks(n, 12) for n in (0, 5, LEAST_ROWS + 1, 900_000, 12 * MOST_ROWS, 120 * MOST_ROWS)] == [1, 1, 2, 12, 12, 120]
