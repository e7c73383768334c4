"""Mixing sources to target weights on a time-varying curriculum.

Source ``s`` has a target of ``T_s`` words and a weight schedule over training
time 0..1, a straight ramp ``1 + a_s (2t - 1)``. Its integral says how many of
its words are due by time ``t``; a document whose words start at word ``c`` of
its source is due when the demand reaches ``c``, the root of a quadratic. A
source shorter than its target starts again, up to three times over; its
documents come in an order drawn by a hash of the id, so reruns agree.

The running word counts are made in two steps, as a source may hold a third of
all rows: sums per (source, hash range), a running total over those few sums,
then running totals inside each range. Only built-in functions are used.

Whole documents are taken: a copy is in if its middle lies before the target,
so a source misses its target by less than half a document.

Null and blank texts have size 0 and are taken 0 times. A null source is a
source of its own, after all others. Rows without ``doc_id`` come first in
their source, by size. Repeated rows are separate documents. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorte.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
#: Slope of a source's ramp, by its weight: light sources fade out, heavy ones grow.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}
#: No document and no source is taken more often.
REPEATS = 3
#: Rows of a hash range, about; ranges of a source at most.
RANGE_ROWS, RANGES = 256, 1 << 16
#: Bits of the id's hash.
BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``name, missing, source_size`` (one row a source) with ``weight, target``.

    The targets share all words by weight, none above REPEATS times its
    source: sources are filled in order of cap / weight, and the level is the
    first one at which the next source isn't above its cap.
    """
    big = lambda c: c.cast("decimal(38,0)")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy("missing", "name")) - 1) % len(WEIGHTS) + 1).cast("int")))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "missing", "name")
    rows = ranked.select(
        "*",
        F.row_number().over(filled).alias("at"),
        F.coalesce(F.sum(F.col("source_size") * REPEATS).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(Window.partitionBy()).alias("all_words"),
    )
    left = F.col("all_words") - F.col("full")
    fits = big(left) * big(F.col("weight")) <= big(F.col("source_size") * REPEATS) * big(F.col("open"))
    level = F.min(F.when(fits, F.struct("at", left.alias("left"), "open"))).over(Window.partitionBy())
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.open").cast("double")
    capped = (F.col("source_size") * REPEATS).cast("double")
    return rows.withColumn("level", level).select("name", "missing", "source_size", "weight", F.when(F.col("at") < F.col("level.at"), capped).otherwise(share).alias("target"))


def mixed(rows: DataFrame, slopes: dict[int, float] = SLOPES) -> DataFrame:
    """``rows`` (``doc_id, source, size`` and others) with ``source_size, target, copies, taken, position``.

    ``position`` (0 to 1) is when the first copy is due; null if none is taken.
    """
    keyed = rows.withColumns({"missing": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "drawn": draw(F.col("doc_id"))})
    count = rows.count()
    bits = min(int(math.log2(RANGES)), max(0, math.ceil(math.log2(max(count, 1) / RANGE_ROWS))))
    keyed = keyed.withColumn("range", F.shiftright("drawn", BITS - bits))
    sums = keyed.groupBy("missing", "name", "range").agg(F.sum("size").alias("words"))
    sources = source_targets(sums.groupBy("missing", "name").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("missing", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(sources, ["missing", "name"])
    within = Window.partitionBy("missing", "name", "range").orderBy(F.col("doc_id").isNotNull(), "drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(ranges, ["missing", "name", "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    begins = [F.col("start") + F.col("source_size") * e for e in range(REPEATS)]
    copies = sum((F.when((F.col("size") > 0) & ((b * 2 + F.col("size")).cast("double") <= F.col("target") * 2), 1).otherwise(0) for b in begins), F.lit(0))
    slope = F.element_at(F.create_map(*(F.lit(x) for w, a in slopes.items() for x in (w, float(a)))), F.col("weight"))
    due = F.col("start").cast("double") / F.col("target")
    position = 2 * due / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * due))
    return (
        placed.withColumn("copies", copies.cast("long"))
        .withColumns({"taken": F.col("copies") * F.col("size"), "position": F.when(F.col("copies") > 0, position)})
        .drop("missing", "name", "range", "weight", "before", "start")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, position``, sorted by position."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return _by_position(mixed(sizes)).select("doc_id", "size", "source_size", "target", "taken", "position")


def _by_position(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("position").asc_nulls_last(), "drawn", "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` sorted by position, with the columns of :func:`mixture` (they replace any of the same name)."""
    new = ("size", "source_size", "target", "taken", "position")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in new]
    return _by_position(mixed(rows)).select(*kept, *new)


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS drawn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), total AS (SELECT sum(source_size) AS t FROM s),
-- the level: raise the share of a unit of weight until nobody above its cap is left out
trial AS (
  SELECT c.source, (any_value(t) - coalesce(sum(o.source_size * 3) FILTER (o.source_size * c.w < c.source_size * o.w), 0)) AS words,
         sum(o.w) FILTER (o.source_size * c.w >= c.source_size * o.w) AS units, any_value(c.source_size) AS source_size, any_value(c.w) AS w
  FROM s c CROSS JOIN s o CROSS JOIN total GROUP BY c.source
), trials AS (SELECT source, words, units, source_size, w FROM trial),
level AS (
  SELECT words, units FROM trials WHERE words * w <= source_size * 3 * units
  ORDER BY CAST(source_size AS DOUBLE) / w LIMIT 1
), targets AS (
  SELECT source, source_size, w,
         CASE WHEN source_size * 3 * units < words * w THEN CAST(source_size * 3 AS DOUBLE)
              ELSE CAST(words * w AS DOUBLE) / CAST(units AS DOUBLE) END AS target
  FROM s CROSS JOIN level
), p AS (
  SELECT d.*, t.source_size, t.w, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY drawn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
         CAST(CAST(2 * start + size AS DOUBLE) <= target * 2 AS BIGINT)
         + CAST(CAST(2 * (start + source_size) + size AS DOUBLE) <= target * 2 AS BIGINT)
         + CAST(CAST(2 * (start + 2 * source_size) + size AS DOUBLE) <= target * 2 AS BIGINT) END AS copies,
         (w - 2) * 0.5::DOUBLE AS a, CAST(start AS DOUBLE) / target AS due
  FROM p
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN 2 * due / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * due)) END AS position
FROM c
"""
