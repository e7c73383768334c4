"""Quality scores by a factorisation machine.

A document's features are its hashed words, statistics of its structure and its
recorded length. The machine weighs every feature and, by low-rank factors, every
pair of features; the sum over pairs comes from the square of sums less the sum
of squares, so a score costs time linear in the features.

The machine is trained by Spark on about SAMPLE labelled rows at most, picked by
a hash of the id; every document is scored on its whole text. Labels, language,
source and id are no features. Label tables may repeat a document (the larger
label counts) or hold nulls (ignored). Null and empty texts have the features of
an empty text. With labels of one class only, or none, every score is that class
(1 without labels). Rows without ``doc_id`` are scored and count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import crc_bucket, sliced, written
from cohorte.llm.shingles import chunks, hash_between, prefix_sums, word_spans

#: Labelled rows trained on, about, at most.
SAMPLE = 20_000
#: Places of hashed words; factors of a feature.
SLOTS, FACTORS = 1 << 12, 4
THRESHOLD = 0.3

_CLASS = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "space": [9, 10, 11, 12, 13, 32],
    "stops": [*b".?"],
    "marks": [*b",;:'\"()-"],
    "shouts": [*b"!"],
    "symbols": [*b"#$%&*+/<=>@[]^_{|}~\\`"],
}
_MEMBER = np.zeros((256, len(_CLASS)))
for _k, _codes in enumerate(_CLASS.values()):
    _MEMBER[_codes, _k] = 1
STATISTICS = (*_CLASS, "length", "recorded", "words", "word_length", "distinct", "commonest", "lines", "line_length", "repeated_lines", "short_lines", "marked_words", "upper_words", "empty")
N = SLOTS + len(STATISTICS)


def statistics(buf: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, recorded: int) -> np.ndarray:
    """Numbers between about 0 and 1 for one text, given as bytes with its words' hashes and spans."""
    n, m = len(buf), len(words)
    shares = np.bincount(buf, minlength=256) @ _MEMBER / max(n, 1)
    _, counts = np.unique(words, return_counts=True)
    lines = bytes(buf).split(b"\n")
    last = buf[ends - 1] if m else np.empty(0, np.uint8)
    first = buf[starts] if m else np.empty(0, np.uint8)
    tail = buf[np.maximum(ends - 2, starts)] if m else first
    return np.array(
        [
            *np.minimum(shares * [1, 1, 4, 2, 10, 10, 10, 5], 1),
            min(np.log1p(n) / 12, 1),
            min(np.log1p(recorded) / 12, 1),
            min(np.log1p(m) / 10, 1),
            min((ends - starts).mean() / 20, 1) if m else 0,
            len(counts) / m if m else 0,
            counts.max() / m if m else 0,
            min(np.log1p(len(lines)) / 8, 1),
            min(np.log1p(n / len(lines)) / 10, 1),
            1 - len(set(lines)) / len(lines),
            sum(len(x) < 20 for x in lines) / len(lines),
            float((_MEMBER[last, 7] + _MEMBER[last, 6] > 0).mean()) if m else 0,
            float(((_MEMBER[first, 1] > 0) & (_MEMBER[tail, 1] + _MEMBER[tail, 6] > 0)).mean()) if m else 0,
            float(m == 0),
        ]
    )


def features(texts: list[str | None], recorded: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text: hashed words (unit length in all), then statistics."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in chunks(raw):
        buf, starts, ends, offsets = word_spans([t.lower() for t in raw[a:b]])
        plain = np.frombuffer(b"\n".join(raw[a:b]) + b"\n", np.uint8)
        words = hash_between(prefix_sums(buf), starts, ends)
        at = np.searchsorted(starts, offsets)
        for i in range(b - a):
            s = slice(at[i], at[i + 1])
            own, o = words[s], offsets[i]
            text = plain[o : offsets[i + 1] - 1]
            stats = statistics(text, own, starts[s] - o, ends[s] - o, recorded[a + i] if recorded[a + i] is not None else len(text))
            slots, counts = np.unique(own & np.uint64(SLOTS - 1), return_counts=True)
            weight = np.log1p(counts)
            if len(weight):
                weight = weight / np.sqrt(np.square(weight).sum())
            held = np.flatnonzero(stats)
            yield np.concatenate((slots.astype(np.int32), (SLOTS + held).astype(np.int32))), np.concatenate((weight, stats[held]))


def _recorded(batch: pa.RecordBatch) -> list[int | None]:
    return batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = list(features(batch.column("text").to_pylist(), _recorded(batch)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
            names=["label", "indices", "values"],
        )


class QualityModel:
    """Weights of a factorisation machine; or a constant probability."""

    def __init__(self, bias: float, linear: np.ndarray | None = None, factors: np.ndarray | None = None, constant: float | None = None) -> None:
        self.bias, self.linear, self.factors, self.constant = bias, linear, factors, constant

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
        """Learn from ``labels`` (doc_id, quality) all of which may be used."""
        known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("label"))
        rows = known.count()
        if rows > sample:
            known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / rows))
        columns = [c for c in ("text", "n_chars") if c in docs.columns]
        # about SAMPLE rows of 16 bytes: broadcast, so texts aren't shuffled
        labelled = docs.select("doc_id", *columns).join(F.broadcast(known), "doc_id").select("label", *columns)
        train = written(labelled.mapInArrow(_rows, "label double, indices array<int>, values array<double>"), "quality")
        classes = {r.label for r in train.select("label").distinct().collect()}  # two at most
        if len(classes) < 2:
            return cls(0.0, constant=classes.pop() if classes else 1.0)
        sparse = F.udf(lambda i, v: Vectors.sparse(N, i, v), VectorUDT())
        fm = FMClassifier(factorSize=FACTORS, stepSize=0.1, maxIter=80, regParam=1e-4, initStd=0.05, seed=7)
        model = fm.fit(train.select("label", sparse("indices", "values").alias("features")))
        return cls(float(model.intercept), model.linear.toArray(), model.factors.toArray())

    def probabilities(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(found), self.constant)
        sizes = np.array([len(i) for i, _ in found])
        index, x = np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))  # never empty: some statistic is above 0
        vx = self.factors[index] * x[:, None]
        pairs = (np.square(np.add.reduceat(vx, at)) - np.add.reduceat(np.square(vx), at)).sum(axis=1) / 2
        z = self.bias + np.add.reduceat(self.linear[index] * x, at) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, score`` (0 to 1) of every row."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    found = list(features(part.column("text").to_pylist(), _recorded(part)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(shared.value.probabilities(found))], names=["doc_id", "score"])

        columns = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
        return docs.select(*columns).mapInArrow(scored, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels a model may learn from: crc32 of the id, modulo 5, is not 0."""
    return labels.filter(crc_bucket(F.col("doc_id"), 5) != 0)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = QualityModel.fit(docs, training_labels(labels)).score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
