import json
import os

import numpy as np
from pyspark.sql import functions as F
from pyspark.ml.feature import VectorAssembler

from cohorte.operators import network as N
from cohorte.operators.split import assign_split
from cohorte.plans.catalog_ml import feature_table
from cohorte.plans.training import MINIBATCH, prepare, score, train
from cohorte.sources.registry import load_latest, save_model

SF = "/root/testdata/sf0.001"


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    layers = [3, 5, 4, 1]
    w = N.initial(layers, 2).weights + rng.normal(0, 0.1, 3 * 5 + 5 + 5 * 4 + 4 + 4 + 1)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    g, loss = N.gradient(x, y, w, layers, [0.0, 0.0], None)
    assert abs(loss - N.cross_entropy(N.forward(x, w, layers), y)) < 1e-12
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = 1e-6
        d = (N.cross_entropy(N.forward(x, w + e, layers), y) - N.cross_entropy(N.forward(x, w - e, layers), y)) / 2e-6
        assert abs(d - g[i]) < 1e-5


def test_dropout_keeps_the_mean():
    rng = np.random.default_rng(1)
    x, y, layers = rng.normal(size=(5, 4)), np.ones(5), [4, 6, 1]
    w = N.initial(layers, 0).weights
    mean = np.mean([N.gradient(x, y, w, layers, [0.5], np.random.default_rng(i))[0][-1] for i in range(4000)])
    # the sigmoid bends, so the means are close, not equal
    whole = N.gradient(x, y, w, layers, [0.0], None)[0][-1]
    assert abs(mean - whole) < 0.05 * abs(whole)


def rows(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no line separates them
    df = spark.createDataFrame([(f"r{i}", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id string, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_one_worker_is_the_plain_loop(spark):
    df = rows(spark)
    m = N.MiniBatchNetwork(idCol="id", hidden=[8], dropout=[0.2], epochs=3, rate=0.01, workers=1, validation=0.25, batchSize=16).fit(df)
    data = assign_split(df, "id", 0.25, 43).orderBy(F.xxhash64("id"), "id").collect()
    x, y, held = np.array([r.features.toArray() for r in data]), np.array([r.label for r in data]), np.array([r.conjunto == "test" for r in data])
    state = N.initial([2, 8, 1], 42)
    for epoch in range(3):
        rng = np.random.default_rng([42, epoch, 0, 0])
        order = rng.permutation(np.flatnonzero(~held))
        for at in range(0, len(order), 16):
            part = order[at : at + 16]
            N.adam(state, N.gradient(x[part], y[part], state.weights, [2, 8, 1], [0.2], rng)[0] / len(part), 0.01)
    assert np.abs(np.array(json.loads(m.getOrDefault(m.weights))["weights"]) - state.weights).max() < 1e-12
    logit = N.forward(x[held], state.weights, [2, 8, 1])
    h = m.get_history()
    assert abs(h[-1]["perdida_validacion"] - N.cross_entropy(logit, y[held]) / held.sum()) < 1e-12
    assert [e["epoca"] for e in h] == [1, 2, 3] and h[0]["filas_entrenamiento"] == (~held).sum() and h[0]["filas_validacion"] == held.sum()


def test_reruns_agree_and_workers_are_averaged(spark):
    df = rows(spark)
    fit = lambda workers: json.loads((m := N.MiniBatchNetwork(idCol="id", hidden=[8], dropout=[0.1], epochs=2, rate=0.01, workers=workers).fit(df)).getOrDefault(m.weights))["weights"]
    assert fit(3) == fit(3) and fit(3) != fit(1)
    a, b = N.initial([2, 1], 1), N.initial([2, 1], 2)
    mean = N.averaged([(3, a), (1, b)])
    assert np.allclose(mean.weights, 0.75 * a.weights + 0.25 * b.weights)


def test_learns_what_no_line_separates(spark):
    df = rows(spark, 800)
    m = N.MiniBatchNetwork(idCol="id", hidden=[16, 8], dropout=[0.1, 0.0], epochs=40, rate=0.01, workers=2).fit(df)
    h = m.get_history()
    assert h[-1]["perdida"] < 0.5 * h[0]["perdida"] and h[-1]["exactitud_validacion"] > 0.85
    p = score(m, df.withColumn("id_paciente", df["id"]))
    assert p.where("(prediccion = 1) = (label = 1)").count() > 700


def test_trained_saved_and_loaded(spark, scratch):
    f = feature_table(spark, SF)
    res = train(f, "neural_network", loop=MINIBATCH)
    assert len(res.history) == 50 and res.history[-1]["perdida"] < res.history[0]["perdida"]
    assert res.architecture["hidden"] == [64, 32, 16] and res.architecture["dropout"][:2] == [0.3, 0.2]
    save_model(spark, os.path.join(scratch, "m"), res.model, res.record("v20240101_000000_000000"))
    model, _ = load_latest(spark, os.path.join(scratch, "m"), "neural_network")
    key = lambda m: sorted((r.id_paciente, r.probabilidad) for r in score(m, prepare(f)).collect())
    assert key(model) == key(res.model)


def test_an_epoch_reads_the_dealt_rows_without_a_shuffle(spark, monkeypatch):
    plans, plain = [], type(spark.range(1)).mapInArrow

    def seen(self, *a, **b):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **b)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", seen)
    N.MiniBatchNetwork(idCol="id", hidden=[4], dropout=[0.0], epochs=2, workers=2).fit(rows(spark))
    assert len(plans) == 3 and not any("Exchange" in p or "Sort" in p for p in plans)


def test_a_step_on_kept_views_is_the_plain_step():
    rng = np.random.default_rng(3)
    layers, x, y = [3, 8, 4, 1], rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    a, b = N.initial(layers, 1), N.initial(layers, 1)
    ra, rb, views = np.random.default_rng(9), np.random.default_rng(9), N.views_of(b.weights, layers)
    for at in range(0, 40, 16):
        part = slice(at, at + 16)
        g, la = N.gradient(x[part], y[part], a.weights, layers, [0.3, 0.0], ra)
        # Adam as it is written down
        a.steps += 1
        a.m = a.m + (1 - N.BETA1) * (g - a.m)
        a.v = a.v + (1 - N.BETA2) * (g * g - a.v)
        a.weights = a.weights - 0.01 * (a.m / (1 - N.BETA1**a.steps)) / (np.sqrt(a.v / (1 - N.BETA2**a.steps)) + N.EPSILON)
        g, lb = N.gradient(x[part], y[part], b.weights, layers, [0.3, 0.0], rb, views)
        N.adam(b, g, 0.01)
        assert la == lb
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.m, b.m) and np.array_equal(a.v, b.v)
