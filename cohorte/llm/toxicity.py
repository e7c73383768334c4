"""Toxic passages: maximum-scoring segments of token log-odds.

1. Words are counted by the number of documents that hold them: in all
   documents (the prior) and in labelled toxic and clean ones. Counters are
   hashed to SLOTS places, so the model has one size however large the corpus.
2. A word's score is the lower bound of its log-odds of standing in a toxic
   document, under a Dirichlet prior made of its share in all documents; or that
   of its first bytes (PREFIX), for word forms that the labels don't cover.
3. A linear scan finds every maximal scoring segment of a text.
4. Extreme-value theory says how often a text of that length without toxic
   words reaches such scores; a document's evidence is its best sum statistic.
   A logistic curve fitted on labelled rows maps evidence to a probability.

Labels are read from at most about SAMPLE labelled rows, picked by a hash of
the id, of which a group of copies counts once; counts of the prior and scores
cover every document. Label tables may
repeat a document (the larger label counts) or hold nulls (ignored). Null and
empty texts have no words: their score is that of no evidence. Without labels
of both classes every score is 0. Rows without ``doc_id`` are scored and count
as not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorte.llm.common import crc_bucket, sliced
from cohorte.llm.segments import evidence, karlin_lambda, maximal_segments
from cohorte.llm.shingles import chunks, hash_between, prefix_sums, shingle_sets, word_spans

#: Labelled rows that the model learns from, about, at most.
SAMPLE = 50_000
SLOTS = 1 << 18
PREFIX = 5
#: Labelled documents with the same least shingle of so many words are one example.
COPY = 5
#: Documents' worth of prior from the word's share in all documents, and a flat one.
PRIOR, FLAT = 20.0, 0.5
#: Standard deviations off the log-odds; cost of a word; scores are kept in thousandths.
DOUBT, COST, UNIT = 1.5, 0.1, 1000
#: Evidence beyond this says no more.
ENOUGH = 20.0
THRESHOLD = 0.3

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Words:
    """Slots of the words of some texts and of their prefixes, text by text."""

    def __init__(self, texts: list[str | None]) -> None:
        self.raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: word slots, prefix slots, where words start and end (bytes of the lower-cased text)."""
        for a, b in chunks(self.raw):
            buf, starts, ends, offsets = word_spans(self.raw[a:b], _BREAK)
            prefix = prefix_sums(buf)
            mask = np.uint64(SLOTS - 1)
            word = (hash_between(prefix, starts, ends) & mask).astype(np.int64)
            form = (hash_between(prefix, starts, np.minimum(ends, starts + PREFIX)) >> np.uint64(20) & mask).astype(np.int64)
            at = np.searchsorted(starts, offsets)
            for i in range(b - a):
                s = slice(at[i], at[i + 1])
                yield word[s], form[s], starts[s] - offsets[i], ends[s] - offsets[i]


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of each text's shingles of COPY words: near copies mostly share it."""
    for batch in sliced(batches):
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        least = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in shingle_sets(texts, COPY)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(least, pa.int64())], names=["doc_id", "y", "least"])


def _counter(label_of: dict[int, int]) -> Callable:
    """Counts documents by slot: in all, toxic and clean ones; prefixes after words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = label_of.value
        n = np.zeros((3, 2 * SLOTS + 1), np.int64)
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            for i, (word, form, _, _) in zip(ids, Words(batch.column("text").to_pylist()), strict=True):
                held = np.concatenate((np.unique(word), SLOTS + np.unique(form), [2 * SLOTS]))
                n[0, held] += 1
                y = labels.get(i)
                if y is not None:
                    n[1 if y else 2, held] += 1
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(n[k, at]) for k in range(3))], names=["slot", "every", "toxic", "clean"])

    return count


def word_scores(word, form, n, own: int | None = None) -> np.ndarray:
    """Scores, in thousandths, of words given by slot; ``own`` takes out a labelled document's own counts."""
    every, toxic, clean = n
    if own is not None:
        toxic, clean = (toxic, own), (clean, 1 - own)
    else:
        toxic, clean = (toxic, 0), (clean, 0)
    share = PRIOR / max(every[-1], 1)

    # a word has to be toxic more often than not, also where toxic documents are the rule
    rule = max(0.0, np.log((toxic[0][-1] - toxic[1] + 1) / (clean[0][-1] - clean[1] + 1)))

    def score(place: np.ndarray) -> np.ndarray:
        prior = share * every[place] + FLAT
        a = toxic[0][place] - toxic[1] + prior
        b = clean[0][place] - clean[1] + prior
        odds = np.log(a / b) - rule
        return np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * np.sqrt(1 / a + 1 / b), 0)

    own_score, form_score = score(word), score(SLOTS + form)
    best = np.where(own_score < 0, own_score, np.maximum(own_score, form_score))
    # documents are counted, so a word is evidence once a text, however often it is repeated
    again = np.ones(len(word), bool)
    again[np.unique(word, return_index=True)[1]] = False
    best[again] = np.minimum(best[again], 0)
    return np.rint(UNIT * (np.clip(best, -2, 6) - COST)).astype(np.int64)


def _examples(label_of, counts) -> Callable:
    """Each labelled document's segments, scored without its own counts; and how often clean ones have which score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, n = label_of.value, counts.value
        seen: dict[int, int] = {}
        for batch in sliced(batches):
            label, words, values = [], [], []
            ids = batch.column("doc_id").to_pylist()
            for i, (word, form, _, _) in zip(ids, Words(batch.column("text").to_pylist()), strict=True):
                y = labels[i]
                scores = word_scores(word, form, n, y)
                label.append(y)
                words.append(len(word))
                values.append([s for s, _, _ in maximal_segments(scores)])
                if not y:
                    for v, k in zip(*np.unique(scores // 50, return_counts=True), strict=True):
                        seen[int(v)] = seen.get(int(v), 0) + int(k)
            yield _example_batch(label, words, values)
        # label -1: a score (in units of 50) and its count
        yield _example_batch([-1] * len(seen), list(seen.values()), [[v] for v in seen])

    return rows


def _example_batch(label, words, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(words, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["label", "n", "scores"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge (labels may be separable)."""
    z = np.column_stack((np.ones_like(x), x))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-1]), z.T @ (y - p) - np.array([1e-3, 1e-1]) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class ToxicityModel:
    """Word counts by slot (fixed size) and the calibration of evidence."""

    def __init__(self, counts: np.ndarray, lam: float, k: float, line: tuple[float, float] | None) -> None:
        self.counts, self.lam, self.k, self.line = counts, lam, k, line

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
        """Learn from ``labels`` (doc_id, toxic) all of which may be used."""
        sc = docs.sparkSession.sparkContext
        known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
        known = known.select(F.col("doc_id").cast("long"), "y")
        rows = known.count()
        if rows > sample:  # a share of the ids, so about SAMPLE rows are collected
            known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / rows))
        texts = docs.select("doc_id", "text")
        # SAMPLE rows at most from here on; a group of copies is one example
        least = texts.join(F.broadcast(known), "doc_id").mapInArrow(_least_shingles, "doc_id long, y int, least long").collect()
        first: dict[tuple[int, int], int] = {}
        for r in least:
            first[r.least, r.y] = min(first.get((r.least, r.y), r.doc_id), r.doc_id)
        label_of = sc.broadcast({i: y for (_, y), i in first.items()})
        summed = texts.mapInArrow(_counter(label_of), "slot long, every long, toxic long, clean long").groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("every", "toxic", "clean")))
        n = np.zeros((3, 2 * SLOTS + 1), np.int32)
        for batch in summed.toArrow().to_batches():  # at most 2 * SLOTS + 1 rows
            n[:, batch.column(0).to_numpy()] = [batch.column(k).to_numpy() for k in (1, 2, 3)]
        if not n[1, -1] or not n[2, -1]:
            return cls(n, 1.0, 1.0, None)
        counts = sc.broadcast(n)
        ids = docs.sparkSession.createDataFrame([(i,) for i in label_of.value], "doc_id long")
        found = texts.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_examples(label_of, counts), "label long, n long, scores array<long>").collect()
        lam, k, line = calibrated([(r.label, r.n, r.scores) for r in found])
        return cls(n, lam, k, line)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` (0 to 1) and ``passages`` (start, end in code points, significance)."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(self)
        schema = "doc_id long, score double, passages array<struct<start: long, end: long, evidence: double>>"

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in sliced(batches):
                yield model.scored(batch)

        return docs.select("doc_id", "text").mapInArrow(scored, schema)

    def scored(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, passages = [], []
        words = Words(batch.column("text").to_pylist())
        for raw, (word, form, starts, ends) in zip(words.raw, words, strict=True):
            found = maximal_segments(word_scores(word, form, self.counts)) if self.line else []
            scores.append(self.probability([s / UNIT for s, _, _ in found], len(word)))
            room = np.log(max(self.k * max(len(word), 1), 1.0))
            kept = [(self.lam * s / UNIT - room, int(starts[a]), int(ends[b - 1])) for s, a, b in found]
            passages.append([{"start": len(raw[:a].decode("utf-8", "ignore")), "end": len(raw[:b].decode("utf-8", "ignore")), "evidence": float(e)} for e, a, b in kept if e > 0])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    def probability(self, segments: list[float], n: int) -> float:
        if not self.line:
            return 0.0
        x = min(evidence(segments, n, self.lam, self.k), ENOUGH)
        return float(1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * x, -30, 30))))


def calibrated(rows: list[tuple[int, int, list[int]]]) -> tuple[float, float, tuple[float, float]]:
    """lambda, K and the logistic line from :func:`_examples`' rows."""
    seen: dict[int, int] = {}
    for y, n, s in rows:
        if y < 0:
            seen[s[0]] = seen.get(s[0], 0) + n
    values = np.array([50 * v / UNIT for v in seen], float)
    share = np.array(list(seen.values()), float)
    lam = karlin_lambda(values, share / share.sum()) if len(seen) else 1.0
    docs = [(y, n, [v / UNIT for v in s]) for y, n, s in rows if y >= 0]
    null = [(n, max(s, default=0.0)) for y, n, s in docs if not y and n]
    k = len(null) / max(sum(n * np.exp(-lam * s) for n, s in null), 1e-9)  # maximum likelihood, given lambda
    x = np.array([min(evidence(s, n, lam, k), ENOUGH) for _, n, s in docs])
    return lam, k, _logistic(x, np.array([float(y) for y, _, _ in docs]))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels a model may learn from: crc32 of the id, modulo 4, is not 2."""
    return labels.filter(crc_bucket(F.col("doc_id"), 4) != 2)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every document."""
    scored = ToxicityModel.fit(docs, training_labels(labels)).score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "passages",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; texts are scored where they are read, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel.fit(docs, training_labels(labels)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = shared.value.scored(batch.select(["doc_id", "text"])).column("score")
            yield batch.filter(pc.less(scores, THRESHOLD))

    return docs.mapInArrow(kept, T.StructType(docs.schema.fields))
