"""Exact order statistics of columns of any size.

The rows are first reduced to one count per value (combined map-side), then
written in ranges of the value. Running totals inside a range are a window over
that range alone; the totals of the ranges (one number per range and group) are
added up separately. No task sees more than a range, and the result does not
depend on the file format, the partitioning or the number of rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorte.functions.numeric import nan_to_null
from cohorte.session import scratch_path

RANGE = "_rango"


def written_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written in ranges of ``keys``, with the number of each row's
    range. Written, because a range partitioning computed twice may differ."""
    spark = df.sparkSession
    path = scratch_path(spark, f"rangos-{uuid.uuid4().hex[:12]}")
    ranged = df.repartitionByRange(*keys).withColumn(RANGE, F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def below(ranged: DataFrame, group: list[str], order: str, weight: str) -> Column:
    """Sum of ``weight`` over the smaller values of the row's own range."""
    w = Window.partitionBy(RANGE, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(w), F.lit(0))


def range_offsets(ranged: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Per group and range: sum of ``weight`` over the ranges before (``_antes``)
    and over the whole group (``_total``); one row per group and range."""
    totals = ranged.groupBy(*group, RANGE).agg(F.sum(weight).alias("_suma"))
    per = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = per.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *group,
        RANGE,
        F.coalesce(F.sum("_suma").over(before), F.lit(0)).alias("_antes"),
        F.sum("_suma").over(per).alias("_total"),
    )


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float]]:
    """Quantiles by linear interpolation per numeric column; NULL and NaN are
    no values, a column without values is left out."""
    if not probs:
        return {}
    cells = [F.struct(F.lit(c).alias("campo"), nan_to_null(F.col(c).cast("double")).alias("valor")) for c in probs]
    stacked = df.select(F.explode(F.array(*cells)).alias("s")).select("s.campo", "s.valor")
    counts = stacked.where("valor IS NOT NULL").groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_ranges(written_ranges(counts, "campo", "valor"), probs)


def quantiles_of_ranges(ranged: DataFrame, probs: dict[str, list[float]], extra: dict[str, tuple[float, int]] | None = None) -> dict[str, list[float]]:
    """The same from counts (``campo, valor, n``) in ranges. ``extra`` adds a value
    that many times to a column: the ranks after it move up, nothing is counted again."""
    extra = {c: x for c, x in (extra or {}).items() if c in probs and x[1]}
    ranges = range_offsets(ranged, ["campo"], "n").collect()  # one row per column and range
    total = {r["campo"]: r["_total"] for r in ranges}
    below_it, upto_it = dict.fromkeys(extra, 0), dict.fromkeys(extra, 0)
    if extra:
        at = [(c, x[0], F.col("campo") == c) for c, x in extra.items()]
        sums = [F.coalesce(F.sum(F.when(mine & (F.col("valor") < v), F.col("n"))), F.lit(0)).alias(f"l{i}") for i, (_, v, mine) in enumerate(at)]
        sums += [F.coalesce(F.sum(F.when(mine & (F.col("valor") <= v), F.col("n"))), F.lit(0)).alias(f"u{i}") for i, (_, v, mine) in enumerate(at)]
        r = ranged.agg(*sums).first()
        for i, (c, _, _) in enumerate(at):
            below_it[c], upto_it[c] = r[f"l{i}"], r[f"u{i}"]

    size = {c: total.get(c, 0) + extra.get(c, (0, 0))[1] for c in probs}

    def place(c: str, rank: int) -> int | None:
        """Rank among the counted values; None for the added one."""
        if c not in extra or rank < below_it[c]:
            return rank
        return rank - extra[c][1] if rank >= upto_it[c] + extra[c][1] else None

    ranks = {c: sorted({q for p in ps for k in _ranks(p, size[c])[:2] if (q := place(c, k)) is not None}) for c, ps in probs.items() if size[c]}
    # only the ranges that hold a wanted rank are read again
    wanted = []
    ends = dict.fromkeys(total, 0)
    for r in sorted(ranges, key=lambda r: r[RANGE], reverse=True):
        campo, start, end = r["campo"], r["_antes"], ends[r["campo"]] or total[r["campo"]]
        wanted += [(campo, r[RANGE], start, k) for k in ranks.get(campo, ()) if start <= k < end]
        ends[campo] = start
    value: dict[tuple[str, int], float] = {}
    if wanted:
        asked = ranged.sparkSession.createDataFrame(wanted, f"campo string, {RANGE} int, _antes long, rango_buscado long")  # two per quantile
        some = F.col(RANGE).isin(sorted({w[1] for w in wanted}))
        placed = ranged.where(some).withColumn("_bajo", below(ranged, ["campo"], "valor", "n"))
        first = F.col("_antes") + F.col("_bajo")
        hit = placed.join(asked, ["campo", RANGE]).where((first <= F.col("rango_buscado")) & (F.col("rango_buscado") < first + F.col("n")))
        value = {(r["campo"], r["rango_buscado"]): r["valor"] for r in hit.collect()}  # two per quantile

    def at_rank(c: str, rank: int) -> float:
        q = place(c, rank)
        return extra[c][0] if q is None else value[c, q]

    return {c: [_between(lambda k: at_rank(c, k), p, size[c]) for p in ps] for c, ps in probs.items() if size[c]}


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    position = p * (n - 1)
    if abs(position - round(position)) < 1e-6:  # p may have been made from a rank
        position = round(position)
    low = math.floor(position)
    return low, math.ceil(position), position - low


def _between(value: Callable[[int], float], p: float, n: int) -> float:
    low, high, share = _ranks(p, n)
    return value(low) * (1 - share) + value(high) * share if share else value(low)
