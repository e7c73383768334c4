import itertools
import random

from cohorte.operators.metrics import auc_frame, classification_metrics


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = 0.0
    for a, b in itertools.product(pos, neg):
        tot += 1.0 if a > b else 0.5 if a == b else 0.0
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame([(y, s) for y, s in pairs], "label int, probability double")
    assert abs(auc_frame(df).first()["auc"] - brute_auc(pairs)) < 1e-12


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, probability double")
    assert auc_frame(df).first()["auc"] is None


def test_confusion_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (1, 0.2, 0), (0, 0.3, 0)], "label int, probability double, prediction int")
    m = classification_metrics(df).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (0, 0, 1, 2)
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1_score"] == 0.0
    assert m["accuracy"] == round(1 / 3, 4)
    assert m["balanced_accuracy"] == 0.5
