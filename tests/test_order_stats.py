"""Order statistics, AUC and vocabularies that no task holds as a whole."""

import os
import random

import numpy as np

from cohorte.operators.clean import IQRWinsoriser
from cohorte.operators.encode import LabelVocabulary, LabelVocabularyModel, hash_bucket, vocabulary
from cohorte.operators.metrics import auc_frame
from cohorte.operators.order_stats import exact_quantiles


def test_quantiles_are_those_of_numpy(spark):
    rng = random.Random(1)
    a = [rng.gauss(0, 100) for _ in range(3001)]
    b = [float(rng.randint(0, 5)) for _ in range(3001)]
    rows = [(x, y, None, float("nan")) for x, y in zip(a, b, strict=True)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, dict.fromkeys("abcd", probs))
    assert set(got) == {"a", "b"}
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.quantile(b, probs))
    assert exact_quantiles(df, {}) == {} and exact_quantiles(df.limit(0), {"a": [0.5]}) == {}
    assert exact_quantiles(spark.createDataFrame([(4.0,), (1.0,), (3.0,), (2.0,)], "x double"), {"x": [0.25, 0.75]}) == {"x": [1.75, 3.25]}


def test_bounds_do_not_depend_on_the_file_format(spark, scratch):
    df = spark.range(50_000).selectExpr("CAST(pow(id % 997, 1.5) AS DOUBLE) AS x")
    bounds = []
    for fmt in ("parquet", "csv"):
        path = os.path.join(scratch, fmt)
        df.write.format(fmt).save(path)
        bounds.append(IQRWinsoriser().fit(spark.read.schema("x double").format(fmt).load(path)).get_bounds())
    assert bounds[0] == bounds[1]


def test_auc_tells_close_scores_apart(spark):
    rng = random.Random(2)
    rows = [(rng.random() * 1e-7 + (1e-9 if i % 2 else 0), i % 2) for i in range(2000)] + [(0.5, 0), (0.5, 1)]
    pos = np.array([s for s, y in rows if y])
    neg = np.array([s for s, y in rows if not y])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "probability double, label int").repartition(5)
    assert abs(auc_frame(df).first()["auc"] - want) < 1e-12
    assert auc_frame(df.where("label = 1")).first()["auc"] is None


def test_a_large_vocabulary_is_joined(spark, scratch):
    df = spark.range(40_000).selectExpr("concat('v', id % 20000) AS big", "concat('s', id % 3) AS small").union(spark.createDataFrame([(None, None)], "big string, small string"))
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(20_000)))}
    assert {r["valor"]: r["codigo"] for r in vocabulary(df, ["big"]).collect()} == order
    model = LabelVocabulary(inputCols=["big", "small"], maxVocabulary=100, folder=os.path.join(scratch, "v")).fit(df)
    assert list(model.get_vocabularies()) == ["small"]
    new = spark.createDataFrame([("v7", "s1"), ("v19999", "s2"), ("unseen", "x"), (None, None)], "big string, small string")
    got = {r["big"]: (r["big_encoded"], r["small_encoded"]) for r in model.transform(new).collect()}
    assert got == {"v7": (order["v7"], 1), "v19999": (order["v19999"], 2), "unseen": (0, 0), None: (0, 0)}
    assert model.transform(df).count() == 40_001


def test_without_a_vocabulary_the_hash_code_stands_in(spark):
    model = LabelVocabularyModel(vocabularies='{"a": ["x", "y"]}')
    model.set(model.inputCols, ["a", "b"])
    row = model.transform(spark.createDataFrame([("y", "k")], "a string, b string")).withColumn("h", hash_bucket("b")).first()
    assert row["a_encoded"] == 1 and row["b_encoded"] == row["h"]
