"""As-of join: for each left row the nearest right row of its key in time (X11).

Both sides are put into one order (key, time) and dealt into ranges of it, so a key
with a third of all rows is many ranges, each a task of its own. A range finds
its matches by itself; what lies beyond its edge is one row per range: the last
(or first) right row of the key that goes on there. No pair of rows is made but the
ones in the result.

Right rows are reduced to one per key and time first (combined map-side); of
several at one time the least by its values counts. Left rows without key or
time, or without a match, keep nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorte.operators.order_stats import RANGE, written_ranges

BACKWARD, FORWARD = "backward", "forward"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    values: dict[str, str],
    direction: str = BACKWARD,
    within_days: int | None = None,
) -> DataFrame:
    """``left`` with ``values`` (column of ``right`` -> name in the result) of the
    last right row at or before its time, or (forward) the first at or after it, no
    more than ``within_days`` away. Times are dates or timestamps of one type."""
    if direction not in (BACKWARD, FORWARD):
        raise ValueError(f"direction: {direction!r}")
    back = direction == BACKWARD
    hit = F.struct(F.col(right_time).alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(right_time).alias("_t")).agg(F.min(hit).alias("_r"))
    whole = F.struct(*[F.col(c) for c in left.columns]).alias("_l")
    usable = F.col(key).isNotNull() & F.col(left_time).isNotNull()
    rows = left.where(usable).select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), whole)
    # at equal times a right row comes where the left one finds it
    order = F.lit(0 if back else 1).alias("_s")
    both = r.select("_k", "_t", order, "_r").unionByName(rows.select("_k", "_t", (1 - order).alias("_s"), "_l"), allowMissingColumns=True)
    # spreads equal left rows (one key, one time) over ranges too
    ranged = written_ranges(both.withColumn("_c", F.when(F.col("_l").isNotNull(), F.monotonically_increasing_id())), "_k", "_t", "_s", "_c")

    w = Window.partitionBy(RANGE, "_k").orderBy("_t", "_s", "_c")
    near = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = ranged.withColumn("_r", near).where("_l IS NOT NULL")
    out = found.join(F.broadcast(_over_the_edge(ranged, back)), RANGE, "left")  # one row per range
    r = F.coalesce("_r", F.when(F.col("_k") == F.col("_edge.k"), F.col("_edge.r")))
    if within_days is not None:
        far = F.abs(F.datediff(r["_t"], F.col("_t"))) > within_days
        r = F.when(~far, r)
    names = list(values.values())
    out = out.withColumn("_m", r).select("_l.*", *[F.col(f"_m._v{i}").alias(n) for i, n in enumerate(names)])
    rest = left.where(~usable)
    types = {f.name: f.dataType for f in out.schema.fields}
    return out.unionByName(rest.select("*", *[F.lit(None).cast(types[n]).alias(n) for n in names]))


def _over_the_edge(ranged: DataFrame, back: bool) -> DataFrame:
    """Per range: the key that it shares with the ranges before (after), and that key's nearest right row there."""
    pick = F.max_by if back else F.min_by
    ends = ranged.groupBy(RANGE).agg(F.min("_k").alias("first"), F.max("_k").alias("last"))
    ends = ends.withColumns({"out": F.col("last") if back else F.col("first"), "into": F.col("first") if back else F.col("last")})
    mine = ranged.where("_r IS NOT NULL").join(F.broadcast(ends.select(RANGE, F.col("out").alias("_k"))), [RANGE, "_k"])
    given = mine.groupBy(RANGE, F.col("_k").alias("k")).agg(pick("_r", "_t").alias("r"))
    asks = ends.select(RANGE, F.col("into").alias("k"), F.lit(None).cast(given.schema["r"].dataType).alias("r"), F.lit(True).alias("asks"))
    # a key has as many rows here as ranges
    step = F.col(RANGE) if back else -F.col(RANGE)
    w = Window.partitionBy("k").orderBy(step, F.col("asks").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    both = given.withColumn("asks", F.lit(None).cast("boolean")).unionByName(asks).withColumn("r", F.last("r", True).over(w))
    return both.where("asks AND r IS NOT NULL").select(RANGE, F.struct("k", "r").alias("_edge"))


