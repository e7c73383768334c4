"""Repeatable train/test split (M3).

A row goes to the test set when a hash of (key, seed) falls in the lowest
``test_fraction`` of 10,000 buckets. It is a narrow, per-row expression: no
shuffle, no global ordering, the same answer on every re-execution, and the
label proportions are kept in expectation (stratified by construction since
the hash does not depend on the label). The hash is MD5 so that any SQL
engine can reproduce the assignment.

:func:`assign_exact_split` takes exactly the wanted share of every label: the
rows with the least hashes. The cut of a label is an order statistic found in
ranges of the hash, so no task holds a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.operators.order_stats import exact_quantiles

BUCKETS = 10_000


def split_bucket(key: Column | str, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS))


def assign_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42, column: str = "conjunto") -> DataFrame:
    cut = int(round(test_fraction * BUCKETS))
    return df.withColumn(column, F.when(split_bucket(key, seed) < cut, F.lit("test")).otherwise(F.lit("train")))


def split_order(key: Column | str, seed: int = 42) -> Column:
    """48 bits of the key's hash: exact as a double."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double")


def assign_exact_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42, column: str = "conjunto") -> DataFrame:
    """The share ``test_fraction`` of every label's rows (rounded half up) is
    the test part; rows without a label train. Labels are few (classes)."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {v: int(n * test_fraction + 0.5) for v, n in counts.items()}
    names = {v: f"clase_{i}" for i, v in enumerate(counts) if wanted[v]}
    hashes = df.select(*(F.when(F.col(label) == F.lit(v), split_order(key, seed)).alias(c) for v, c in names.items()))
    # the rank of the last test row as a quantile of the label's hashes
    cuts = exact_quantiles(hashes, {c: [(wanted[v] - 1) / max(counts[v] - 1, 1)] for v, c in names.items()})
    test = F.lit(False)
    for v, c in names.items():
        test = test | ((F.col(label) == F.lit(v)) & (split_order(key, seed) <= F.lit(cuts[c][0])))
    return df.withColumn(column, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def train_test(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, key, test_fraction, seed, "_conjunto")
    return (
        s.where(F.col("_conjunto") == "train").drop("_conjunto"),
        s.where(F.col("_conjunto") == "test").drop("_conjunto"),
    )
