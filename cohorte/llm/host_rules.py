"""Quality rules by host.

Every text is measured once: words, symbols, repeated lines and repeated passages.
Some rules judge a document alone (``base_failed``). Softer ones are too weak for
that, as clean texts fail them now and then; they count where the document's host
(its ``source``) makes a habit of failing them.

Per host and rule the failures are summed. A host with few documents proves
little, so its rate is drawn towards the rates of all hosts by a beta prior, whose
mean and weight are fitted to the hosts by moments: with failures ``f`` of ``n``
documents the rate is ``(f + m s) / (n + s)``. A host is marked for a rule if that
rate reaches MARKED. The verdicts are joined back to the documents: one goes if it
fails a rule that its host is marked for.

A text's measures take no more than its length; the table of measures is written
once and read twice. Host sums are combined before the shuffle, and the verdicts
of the largest hosts are broadcast within a bound, so no host is in one task.

Null and blank texts have no words and fail. Documents without ``source`` form one
host. Rows without ``doc_id`` and repeated rows are documents like others. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import WORD, sliced, written
from cohorte.llm.skew import batch_of, weighted_join

#: Words of a repeated passage.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Least words, and most repeated words in percent, of a document by itself.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Soft rules: a host fails them by habit from this shrunk rate on.
MARKED = 0.5
#: Documents that the prior weighs at least: a host is never judged by one or two.
LEAST_PRIOR = 10

_WORD = re.compile(WORD)
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")

#: Rule -> SQL over the measures of a document.
SOFT: dict[str, str] = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 10 * n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
}


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of WINDOW words found twice or more.

    Windows get exact numbers by pairing the numbers of shorter ones.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[str, int] = {}
    one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    ids, size = one, 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        # a window of size + step words: two windows of size words that overlap
        pair = ids[: len(ids) - step] * n + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        size += step
    hits = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(hits):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; lines with a word only."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), len(_NOT_SYMBOL.sub("", text)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [measures(t.as_py()) for t in batch.column(2)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
        yield batch_of(doc_id=batch.column(0), source=batch.column(1), **{n: pa.array(c, pa.int64()) for n, c in zip(NAMES, columns, strict=True)})


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the measures of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_measured, "doc_id long, source string, " + ", ".join(f"{n} long" for n in NAMES))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def host_rates(docs: DataFrame, soft: dict[str, str] = SOFT) -> DataFrame:
    """One row per host: ``name`` (null: null source), ``n``, and per rule its failures and the shrunk rate."""
    fails = [F.count_if(F.expr(rule)).alias(f"fails_{r}") for r, rule in soft.items()]
    hosts = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *fails), "hosts")
    prior = beta_priors(hosts, soft)
    rate = lambda r: (F.col(f"fails_{r}") + F.lit(prior[r][0])) / (F.col("n") + F.lit(prior[r][0] + prior[r][1]))
    return hosts.withColumns({f"rate_{r}": rate(r) for r in soft})


def beta_priors(hosts: DataFrame, soft: dict[str, str] = SOFT) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule's prior, by moments of the hosts' rates (one row of sums to the driver).

    The variance of the rates less what chance alone gives is the variance
    between hosts. Where nothing is left, hosts don't differ and the prior
    weighs as much as all documents.
    """
    n, h = F.col("n").cast("double"), F.count(F.lit(1)).cast("double")
    sums = [h.alias("h"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for r in soft:
        f = F.col(f"fails_{r}").cast("double")
        sums += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / n).alias(f"ff_{r}")]
    s = hosts.agg(*sums).first()
    out = {}
    for r in soft:
        if not s["n"]:
            out[r] = (0.5, 0.5)
            continue
        mean = s[f"f_{r}"] / s["n"]
        chance = mean * (1 - mean)
        spread = s[f"ff_{r}"] - s["n"] * mean * mean  # sum of n (rate - mean)^2
        spare = s["n"] - s["nn"] / s["n"]
        between = (spread - (s["h"] - 1) * chance) / spare if spare > 0 else 0.0
        weight = min(chance / between - 1 if between > 0 and chance > 0 else s["n"], s["n"])
        weight = max(weight, float(LEAST_PRIOR))
        out[r] = (mean * weight, (1 - mean) * weight)
    return out


def judged(docs: DataFrame, soft: dict[str, str] = SOFT, marked: float = MARKED) -> DataFrame:
    """Every document with its measures, ``base_failed``, ``host_marks`` (rules that its host is marked for) and ``kept``."""
    rows = written(measured(docs), "measures").withColumn("host", F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name")))
    rates = host_rates(rows, soft)
    marks = F.concat(F.lit(","), *(F.when(F.col(f"rate_{r}") >= marked, f"{r},").otherwise("") for r in soft))
    hosts = written(rates.select(F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name")).alias("host"), F.col("n").alias("weight"), marks.alias("marks")), "verdicts")
    total = hosts.agg(F.sum("weight")).first()[0] or 0
    joined = weighted_join(rows, hosts, "host", "weight", total)
    hit = [F.col("marks").contains(f",{r},") & F.expr(rule) for r, rule in soft.items()]
    habit = F.lit(False)
    for h in hit:
        habit = habit | h
    return joined.select("doc_id", "source", *NAMES, base_failed().alias("base_failed"), F.trim(F.col("marks"), F.lit(",")).alias("host_marks"), (~base_failed() & ~habit).alias("kept"))


def host_quality(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``host_marks``."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_marks")



_W = r"[^\x20\x09-\x0D]+"
_FAILS = ",\n         ".join(f"count(*) FILTER ({rule}) AS fails_{r}" for r, rule in SOFT.items())
_PRIORS = ",\n         ".join(
    f"sum(fails_{r}) / sum(n) AS m_{r}, (sum(fails_{r}::DOUBLE * fails_{r} / n) - sum(fails_{r})::DOUBLE * sum(fails_{r}) / sum(n)"
    f" - (count(*) - 1) * (sum(fails_{r}) / sum(n)) * (1 - sum(fails_{r}) / sum(n))) / nullif(sum(n) - sum(n::DOUBLE * n) / sum(n), 0) AS v_{r}"
    for r in SOFT
)
_WEIGHTS = ", ".join(f"greatest(least(CASE WHEN v_{r} > 0 AND m_{r} * (1 - m_{r}) > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE total END, total), {LEAST_PRIOR}) AS s_{r}" for r in SOFT)
_MARKS = " || ".join(f"CASE WHEN (fails_{r} + m_{r} * s_{r}) / (n + s_{r}) >= {MARKED} THEN '{r},' ELSE '' END" for r in SOFT)
_HABIT = " OR ".join(f"(marks LIKE '%,{r},%' AND ({rule}))" for r, rule in SOFT.items())

SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines
  FROM documents
), win AS (
  SELECT k, i, words[i:i + 4] AS five FROM doc, unnest(range(1, len(words) - 3)) AS u(i)
), twice AS (
  SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, five) > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, unnest(range(0, 5)) AS v(j) GROUP BY k
), m AS (
  SELECT k, doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc LEFT JOIN covered USING (k)
), host AS (
  SELECT source, count(*) AS n,
         {_FAILS}
  FROM m GROUP BY source
), prior AS (
  SELECT sum(n)::DOUBLE AS total,
         {_PRIORS}
  FROM host
), weighed AS (
  SELECT *, {_WEIGHTS} FROM prior
), verdict AS (
  SELECT source, ',' || {_MARKS} AS marks FROM host, weighed
), judged AS (
  SELECT m.*, marks, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed
  FROM m JOIN verdict v ON m.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_HABIT}) AS kept, trim(marks, ',') AS host_marks
FROM judged"""
