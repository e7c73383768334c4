"""Benchmark decontamination by template windows.

A text's words become template tokens: numbers, names (capitalised words inside
a sentence) and units after a number turn into typed placeholders, so a question
with other numbers and names has the same template. Windows of K tokens of the
benchmark, with enough literal words, are hash-joined with those of every
document. The windows of one document and item on one diagonal (document
position less item position) are one candidate passage; its placeholders have to
be filled consistently: one value of the item always stands for one value of the
document, and the other way round. A passage counts if it covers RUN words, or
the whole of a shorter item.

Beside the templates, windows of the lower-cased words and numbers themselves are
joined in the same pass. A verbatim passage has those whatever stands around it and
whatever it consists of, so neither the share of literal words nor the context of a
name can hide it.

Only built-in functions are used. Items under SHORT tokens are no evidence and
left out; items of SHORT to K - 1 tokens are joined whole. Null and empty texts
have no windows. Repeated rows of a document or an item count once. Rows without
``doc_id`` can't be named: they are reported as clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import bounded_broadcast, written

K = 8
RUN = 13
SHORT = 5
#: Literal words that a window of the benchmark needs, as a share.
LITERAL = 0.6
#: Windows of the benchmark broadcast at most (about 32 MB); beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# Common units of measure and money, and number words.
UNITS = (
    "mm cm m km mg g kg ml l s sec min h hr in ft yd mi oz lb meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter "
    "liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar "
    "dollars cent cents euro euros percent degree degrees usd eur gbp"
).split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_MARKED = r"([\p{Ll}\p{N},;] )(\p{Lu})"
_TOKEN = r"\x01?\p{L}[\p{L}\p{N}'’]*|[0-9]+(?:[.,:/][0-9]+)*[\p{L}%]*"


def raw_tokens(text: Column) -> Column:
    """Lower-cased words and numbers; names carry a mark in front."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_MARKED), F.lit("$1\x01$2"))), F.lit(_TOKEN), F.lit(0))


def template(raw: Column) -> Column:
    """One template token for each raw token. What sorts before ":" starts with a mark or a digit."""

    def number(x: Column) -> Column:
        return x.between("0", ":") | x.isin(NUMBER_WORDS)

    def token(x: Column, before: Column) -> Column:
        return F.when(x < "0", NAME).when(number(x), NUMBER).when(number(before) & x.isin(UNITS), UNIT).otherwise(x)

    # the word before comes by zip_with: a lambda that names ``raw`` could have
    # the whole tokenisation put into it, for every word
    return F.zip_with(raw, F.slice(F.concat(F.array(F.lit("")), raw), F.lit(1), F.size(raw)), token)


#: Kinds of windows: template tokens, or the words and numbers themselves.
TEMPLATE, PLAIN = 0, 1


def plain(raw: Column) -> Column:
    """Raw tokens without the marks of names."""
    return F.transform(raw, lambda x: F.when(x < "0", F.substring(x, 2, 1 << 30)).otherwise(x))


def _windows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key, at, kind, window`` (hash) of each window of ``k`` tokens, both kinds, with the tokens of the text."""
    # outer: Spark would put a filter on the generated arrays below the tokenisation and tokenise twice;
    # the window of the null row matches nothing
    starts = F.when(F.size("template") >= k, F.sequence(F.lit(0), F.size("template") - k))
    placed = rows.select(key, "raw", "template", "plain", F.explode_outer(starts).alias("at"))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(k + 100 * kind), *(F.get(c, F.col("at") + j) for j in range(k))).alias("window")) for kind, c in ((TEMPLATE, "template"), (PLAIN, "plain"))]
    return placed.select(key, "at", "raw", "template", "plain", F.inline(F.array(*kinds)))


def _tokens(rows: DataFrame, key: str) -> DataFrame:
    raw = rows.select(key, raw_tokens(F.col("text")).alias("raw"))
    return raw.select(key, "raw", template(F.col("raw")).alias("template"), plain(F.col("raw")).alias("plain"))


def _benchmark(items: DataFrame) -> DataFrame:
    """Windows of the items that may be evidence: ``item_id, n_tokens, k, from, kind, window, item_raw, slots``."""
    tokens = written(_tokens(items.filter("item_id IS NOT NULL"), "item_id"), "items")
    tokens = tokens.withColumn("k", F.least(F.size("template"), F.lit(K))).filter(F.col("k") >= SHORT)
    parts = []
    for k in range(SHORT, K + 1):
        rows = _windows(tokens.filter(F.col("k") == k), "item_id", k)
        own = F.when(F.col("kind") == TEMPLATE, F.col("template")).otherwise(F.col("plain"))
        rows = rows.select("item_id", F.size("template").alias("n_tokens"), F.lit(k).alias("k"), F.col("at").alias("from"), "kind", "window", F.slice("raw", F.col("at") + 1, k).alias("item_raw"), F.slice(own, F.col("at") + 1, k).alias("slots"))
        parts.append(rows.filter((F.col("kind") == PLAIN) | (F.size(F.filter("slots", lambda x: x >= "0")) >= F.ceil(F.lit(LITERAL * k)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.dropDuplicates(["item_id", "from", "kind", "window"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words``: passages of items in documents, words covered by the longest."""
    bench = written(_benchmark(items), "bench")
    sizes = {r.k: r["count"] for r in bench.groupBy("k").count().collect()}  # at most K rows
    tokens = _tokens(docs.filter("doc_id IS NOT NULL"), "doc_id")
    hits = None
    for k, n in sorted(sizes.items()) or [(K, 0)]:
        probe = bounded_broadcast(bench.filter(F.col("k") == k), n, BROADCAST_WINDOWS)
        placed = _windows(tokens, "doc_id", k)
        if n > BROADCAST_WINDOWS:  # the join shuffles: windows travel, not whole texts
            placed = placed.select("doc_id", "at", "kind", "window", F.slice("raw", F.col("at") + 1, k).alias("doc_raw"))
            found = placed.join(probe, ["kind", "window"])
        else:
            found = placed.join(probe, ["kind", "window"]).withColumn("doc_raw", F.slice("raw", F.col("at") + 1, k))
        found = found.select("doc_id", "item_id", "n_tokens", "kind", (F.col("at") - F.col("from")).alias("diagonal"), "from", "k", "doc_raw", "item_raw", "slots")
        hits = found if hits is None else hits.union(found)
    # bounded by an item's length: one entry a window of the item
    passages = hits.groupBy("doc_id", "item_id", "kind", "diagonal").agg(F.first("n_tokens").alias("n_tokens"), F.collect_set(F.struct("from", "k", "doc_raw", "item_raw", "slots")).alias("windows"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["from"], w["from"] + w["k"] - 1)))))
    cells = F.flatten(F.transform("windows", lambda w: F.zip_with(w["slots"], F.zip_with(w["item_raw"], w["doc_raw"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s, v: F.struct(s.alias("slot"), v["a"].alias("a"), v["b"].alias("b")))))
    filled = F.array_distinct(F.filter(cells, lambda c: c["slot"] < "0"))
    values = passages.select("doc_id", "item_id", "n_tokens", covered.alias("words"), filled.alias("filled"))
    side = lambda name: F.size(F.array_distinct(F.transform("filled", lambda c: F.struct(c["slot"], c[name]))))
    good = values.filter((F.col("words") >= F.least(F.lit(RUN), F.col("n_tokens"))) & (side("a") == F.size("filled")) & (side("b") == F.size("filled")))
    return good.groupBy("doc_id", "item_id").agg(F.max("words").cast("long").alias("words"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, n_items, items`` (ids, sorted), ``words`` (longest passage)."""
    found = leaks(docs, items).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("words").alias("words"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of an item."""
    hit = written(leaks(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(bounded_broadcast(hit, hit.count(), BROADCAST_WINDOWS), "doc_id", "left_anti")


def _sql() -> str:
    """The same result in DuckDB SQL: tokens as rows, windows as lists of them."""
    numbers, units = (", ".join(f"'{w}'" for w in words) for words in (NUMBER_WORDS, UNITS))

    def tokens(name: str, key: str, table: str) -> str:
        return f"""
{name}_raw AS (
  SELECT {key}, row_number() OVER () AS r, regexp_extract_all(
    lower(regexp_replace(coalesce(text, ''), '([\\p{{Ll}}\\p{{N}},;] )(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')),
    '\\x01?\\p{{L}}[\\p{{L}}\\p{{N}}''’]*|[0-9]+(?:[.,:/][0-9]+)*[\\p{{L}}%]*') AS words
  FROM {table} WHERE {key} IS NOT NULL
), {name}_word AS (
  SELECT {key}, r, len(words) AS n, generate_subscripts(words, 1) AS i, unnest(words) AS x FROM {name}_raw
), {name}_kind AS (
  SELECT *, (x BETWEEN '0' AND ':') OR x IN ({numbers}) AS number FROM {name}_word
), {name}_token AS (
  SELECT *, CASE WHEN x < '0' THEN chr(1) WHEN number THEN chr(2)
                 WHEN lag(number) OVER (PARTITION BY r ORDER BY i) AND x IN ({units}) THEN chr(3) ELSE x END AS y FROM {name}_kind
), {name}_window AS (
  SELECT {key}, r, n, i, list(y) OVER w AS slots, list(x) OVER w AS raw, list(ltrim(x, chr(1))) OVER w AS plain
  FROM {name}_token WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)
)"""

    return f"""
WITH sizes AS (SELECT unnest(range({SHORT}, {K + 1})) AS k),
{tokens("d", "doc_id", "documents")}, {tokens("b", "item_id", "benchmark")},
bench AS (
  SELECT item_id, n, i, least(n, {K}) AS k, kind, CASE kind WHEN 0 THEN slots[1:least(n, {K})] ELSE plain[1:least(n, {K})] END AS slots, raw[1:least(n, {K})] AS raw
  FROM b_window, range(2) AS kinds(kind) WHERE n >= {SHORT} AND i <= n - least(n, {K}) + 1
), evidence AS (
  SELECT DISTINCT * FROM bench WHERE kind = 1 OR len([s FOR s IN slots IF s >= '0']) >= ceil({LITERAL} * k)
), placed AS (
  SELECT doc_id, i, raw, sizes.k, kind, CASE kind WHEN 0 THEN slots[1:sizes.k] ELSE plain[1:sizes.k] END AS slots
  FROM d_window, sizes, range(2) AS kinds(kind) WHERE len(slots) >= sizes.k
), hit AS (
  SELECT d.doc_id, e.item_id, e.n, e.k, e.kind, e.i AS j, d.i - e.i AS diagonal, unnest(range(e.k)) AS o, e.slots, e.raw AS a, d.raw[1:e.k] AS b
  FROM evidence e JOIN placed d ON d.k = e.k AND d.kind = e.kind AND d.slots = e.slots
), cell AS (
  SELECT DISTINCT doc_id, item_id, n, kind, diagonal, j + o AS place, slots[o + 1] AS slot, a[o + 1] AS a, b[o + 1] AS b FROM hit
), passage AS (
  SELECT doc_id, item_id, n, kind, diagonal, count(DISTINCT place) AS words,
         count(DISTINCT slot || a || chr(9) || b) FILTER (slot < '0') AS pairs,
         count(DISTINCT slot || a) FILTER (slot < '0') AS froms, count(DISTINCT slot || b) FILTER (slot < '0') AS tos
  FROM cell GROUP BY ALL
), leak AS (
  SELECT doc_id, item_id, max(words) AS words FROM passage
  WHERE words >= least({RUN}, n) AND pairs = froms AND pairs = tos GROUP BY ALL
), doc AS (
  SELECT doc_id, list_sort(list(item_id)) AS items, max(words) AS words FROM leak GROUP BY ALL
)
SELECT documents.doc_id, doc.doc_id IS NOT NULL AS contaminated, coalesce(len(items), 0) AS n_items,
       coalesce(array_to_string(items, ','), '') AS items, coalesce(words, 0) AS words
FROM documents LEFT JOIN doc USING (doc_id)"""


SQL = _sql()
