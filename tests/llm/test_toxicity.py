import itertools
import random
import zlib

import numpy as np

from cohorte.llm.common import table
from cohorte.llm.segments import evidence, karlin_lambda, maximal_segments
from cohorte.llm.toxicity import THRESHOLD, toxicity, without_toxic


def brute_segments(s):
    """Recursive definition: the best segment (of equal ones the shortest), then left and right of it."""
    best = max(((sum(s[a:b]), a - b, -a) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    score, a = best[0], -best[2]
    b = a - best[1]
    return brute_segments(s[:a]) + [(score, a, b)] + [(v, x + b, y + b) for v, x, y in brute_segments(s[b:])]


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.choice([-7, -3, -2, -1, 1, 2, 4, 9]) for _ in range(rng.randint(0, 14))]
        got, want = maximal_segments(np.array(s, np.int64)), brute_segments(s)
        assert got == want, s


def test_extreme_values():
    lam = karlin_lambda(np.array([-1.0, 1.0]), np.array([0.75, 0.25]))
    assert abs(lam - np.log(3)) < 1e-6
    assert evidence([], 10, lam, 0.1) == 0.0
    assert evidence([9.0], 100, lam, 0.1) > evidence([9.0], 10_000, lam, 0.1) > 0
    assert evidence([9.0, 8.0], 100, lam, 0.1) > evidence([9.0], 100, lam, 0.1)


def auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert auc([(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]) > 0.9


def test_messy_rows(spark, messy, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(messy, empty).collect()} == {(0.0, 0)}
    assert toxicity(no_docs, empty).count() == 0
    # repeated, contradicting and null labels
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0), (12, 0, 0), (12, 0, 1), (13, 0, 1), (None, 1, 1), (10, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(messy, labels)
    assert got.count() == messy.count() and got.filter("score IS NULL").count() == 0
    kept = without_toxic(messy, empty)
    assert kept.schema == messy.schema and kept.count() == messy.count()
