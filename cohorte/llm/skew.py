"""Helpers against hot keys: joins in two parts, merges in two steps, ordered passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys broadcast by :func:`weighted_join` at most.
HOT_KEYS = 20_000


def weighted_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``big`` inner joined with ``small`` (one row per ``key``), no key in one task.

    ``weight`` bounds the rows of ``big`` with the key, ``total`` their sum. Keys
    above ``total / HOT_KEYS``, so at most HOT_KEYS, are broadcast; the others
    are joined by shuffle, each with at most that many rows.
    """
    bound = total / HOT_KEYS
    hot = small.filter(F.col(weight) > bound).drop(weight)
    cold = small.filter(F.col(weight) <= bound).drop(weight)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-partitioned and sorted; a stretch of equal leading keys may span partitions."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run of equal ``keys``."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def merged_by_key(parts: DataFrame, key: str, merge: Callable[[bytes | None, bytes], bytes], tasks: int) -> DataFrame:
    """``key, data``: one row per key, ``data`` of all ``parts`` (``part, key, data``) merged.

    In two steps, so a task merges about the square root of ``tasks`` parts of a key.
    """
    salts = max(1, math.isqrt(max(tasks, 1)))

    def fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, bytes] = {}
        for frame in rows:
            for k, data in zip(frame[key], frame["data"], strict=True):
                held[k] = merge(held.get(k), data)
        yield pd.DataFrame({key: list(held), "data": list(held.values())})

    def group(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for data in frame["data"]:
            out = merge(out, data)
        return pd.DataFrame({key: [k[0]], "data": [out]})

    schema = T.StructType([parts.schema[key], T.StructField("data", T.BinaryType())])
    if salts > 1:
        salted = parts.repartition(F.col(key), F.col("part") % salts).select(key, "data")
        parts = salted.mapInPandas(fold, schema)
    return parts.select(key, "data").groupBy(key).applyInPandas(group, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
