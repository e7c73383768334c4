"""Key-based upsert with statistics.

Without a table format that supports ``MERGE INTO`` the upsert is an
anti-join plus a union: base rows whose key is not in the batch, then every
batch row. The batch side is de-duplicated first, so the base never
multiplies.

The base is the big side (the whole table) and the batch usually a small
delivery. A sort-merge anti-join would shuffle the whole base on every
batch, so when the batch's key count is known and below
``broadcast_keys`` the batch keys are broadcast and the base is only
scanned and filtered where it lies. Above the bound the planner's
shuffle join is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed bound: batch keys broadcast at most (string keys of ~20 bytes make
# this about 100 MB as a hash relation).
BROADCAST_KEYS = 1_000_000


def _keys(batch: DataFrame, key: str, n_keys: int | None, limit: int) -> DataFrame:
    keys = batch.select(key)
    return F.broadcast(keys) if n_keys is not None and n_keys <= limit else keys


def upsert(base: DataFrame, batch: DataFrame, key: str, n_keys: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Update every column of existing keys, insert new keys.

    ``n_keys`` is the (checked) number of batch keys; pass it to allow the
    broadcast anti-join."""
    kept = base.join(_keys(batch, key, n_keys, broadcast_keys), key, "left_anti")
    return kept.unionByName(batch.select(*base.columns))


def upsert_stats(base: DataFrame, batch: DataFrame, key: str, n_keys: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row ``(insertados, actualizados)`` for a de-duplicated batch:
    updated = base keys found in the batch (semi-join, base not shuffled
    when the batch keys are broadcast), inserted = batch keys - updated."""
    updated = base.select(key).join(_keys(batch, key, n_keys, broadcast_keys), key, "left_semi").agg(
        F.count(F.lit(1)).alias("actualizados")
    )
    total = batch.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_k"))
    # two one-row aggregates side by side (equi-join on a constant key)
    return total.join(updated.withColumn("_k", F.lit(1)), "_k").select(
        (F.col("n") - F.col("actualizados")).alias("insertados"), "actualizados"
    )
