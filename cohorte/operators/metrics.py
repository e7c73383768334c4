"""Classification metrics as aggregates.

All metrics of a scored DataFrame come from one aggregate (confusion
counts) plus, for the AUC, one aggregate per distinct score. The exact AUC
is the trapezoid area of the ROC curve, i.e. the probability that a random
positive outscores a random negative with ties counted half:

    AUC = sum_s pos(s) * (neg(< s) + neg(s) / 2) / (P * N)

``neg(< s)`` is a running sum over the distinct scores, made per range of
scores plus the sums of the ranges before
(:mod:`cohorte.operators.order_stats`): exact, and no task holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.functions.numeric import round_to, safe_ratio
from cohorte.operators.order_stats import RANGE, below, range_offsets, written_ranges


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def auc_frame(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row ``auc`` (NULL when only one class is present)."""
    y = F.col(label).cast("int")
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ranged = written_ranges(per, "s")
    placed = ranged.withColumn("_bajo", below(ranged, [], "s", "neg")).join(range_offsets(ranged, [], "neg"), RANGE)
    area = F.col("pos") * (F.col("_antes") + F.col("_bajo") + F.col("neg") / 2.0)
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return placed.agg(F.when(both, F.sum(area) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column, digits: int = 4) -> list[Column]:
    """A16 + X16 from confusion counts, 0 when undefined."""
    total = tp + fp + tn + fn
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    specificity = safe_ratio(tn, tn + fp)
    return [
        round_to(safe_ratio(tp + tn, total), digits).alias("accuracy"),
        round_to(precision, digits).alias("precision"),
        round_to(recall, digits).alias("recall"),
        round_to(f1, digits).alias("f1_score"),
        round_to((recall + specificity) / 2, digits).alias("balanced_accuracy"),
    ]


def classification_metrics(
    df: DataFrame, label: str = "label", score: str = "probability", prediction: str = "prediction", digits: int = 4
) -> DataFrame:
    """M7: one row with n, confusion counts, accuracy, precision, recall,
    f1_score, balanced_accuracy and auc (all rounded to ``digits``)."""
    c = confusion(df, label, prediction)
    a = auc_frame(df, label, score)
    counts = c.select("tp", "fp", "tn", "fn", F.lit(1).alias("_k"))
    auc = a.select(round_to(F.col("auc"), digits).alias("auc"), F.lit(1).alias("_k"))
    joined = counts.join(auc, "_k")  # one row each side
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return joined.select(
        (tp + fp + tn + fn).alias("n"), "tp", "fp", "tn", "fn", *metric_columns(tp, fp, tn, fn, digits), "auc"
    )
