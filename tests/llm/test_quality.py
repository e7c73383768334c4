import zlib

from cohorte.llm.common import table
from cohorte.llm.quality import N, QualityModel, features, quality
import numpy as np


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    model = QualityModel(0.3, rng.normal(size=N), rng.normal(size=(N, 3)))
    found = list(features(["one two two three!!", "", None, "é " * 50, "x"], [None, 0, None, 7, 10**9]))
    for p, (index, x) in zip(model.probabilities(found), found, strict=True):
        v = model.factors[index]
        pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(len(x)) for b in range(a))
        z = 0.3 + model.linear[index] @ x + pairs
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) > 0.85 * len(pos) * len(neg)


def test_messy_rows(spark, messy, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality(messy, empty).collect()} == {1.0}
    assert quality(no_docs, empty).count() == 0
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0), (12, 0, 0), (12, 1, 1), (13, 0, 1), (7, 0, 0), (None, 1, 1), (10, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality(messy.drop("n_chars"), labels)
    assert got.count() == messy.count() and got.filter("score IS NULL").count() == 0
