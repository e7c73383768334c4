import math

import numpy as np
import pytest
from pyspark.sql import types as T

from cohorte.llm import whitening as W

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("n", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("x", T.StringType()),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", "c", "x") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, dim, k=4):
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    keep = [j for j in range(dim - 1, -1, -1) if e[j] > 1e-9 * max(e[-1], 1e-300)][:k]
    out = {}
    for i, x in usable:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        for c, j in enumerate(keep, 1):
            out.setdefault((i, c), []).append((n, dev, abs(float(centred @ u[:, j]) / math.sqrt(e[j])), e[j] / np.trace(v)))
    return out


def check(got, want):
    seen = {}
    signs = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    assert seen.keys() == want.keys()
    for key, rows in seen.items():
        assert len(rows) == len(want[key])
        for r, (n, dev, size, share) in zip(sorted(rows, key=lambda r: r.deviation or 0), sorted(want[key], key=lambda w: w[1])):
            assert (r.n, r.deviation) == (n, dev)
            assert abs(r.whitened) == pytest.approx(size, rel=1e-7, abs=1e-9)
            assert r.explained == pytest.approx(share, rel=1e-9)
            assert r.identity_error < 1e-9
            signs.setdefault(r.component, set()).add(r.identity_error)


def test_equals_the_library_of_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies: fitted once
    rows += [(None, rows[1][1]), (7, rows[7][1]), (2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [0.0] * 6), (2006, [-0.0] * 6)]
    got = W.whiten(frame(spark, rows)).collect()
    check(got, brute(rows, 6))
    axis = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(axis[1000 + i, c] == axis[0, c] for i in range(200) for c in (1, 2, 3, 4))  # one sign for all rows


def test_lengths_apart_and_too_few_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(40)]
    rows += [(100 + i, [float(c) for c in rng.standard_normal(2)]) for i in range(2)]  # one direction
    rows += [(200, [1.0, 2.0, 3.0, 4.0])] * 3  # no variance
    got = W.whiten(frame(spark, rows)).collect()
    check([r for r in got if r.vec_id < 100], brute(rows, 3))
    assert {(r.vec_id, r.component) for r in got if r.vec_id >= 100} == {(100, 1), (101, 1)}


def test_entries_beyond_64_bits(spark):
    rows = [(i, [float(i), 3e38 if i == 3 else 1.0]) for i in range(5)]
    got = W.whiten(frame(spark, rows)).collect()
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in got)


def test_empty(spark):
    assert W.whiten(frame(spark, [])).collect() == []


def test_exact_deviation_of_large_numbers():
    x = np.array([[2**40, -(2**40)], [1, 2]], np.int64)
    sums = [2**40 + 1, 2 - 2**40]
    assert W.deviations(x, 2, sums) == [None if v > W._TOP else v for v in (sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "diagonal", "equal", "low rank", "close"])
def test_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    b = rng.standard_normal((n, 2))
    q = np.linalg.qr(a)[0]
    v = {"full": a @ a.T, "diagonal": np.diag(np.arange(n) + 1.0), "equal": 3.0 * np.eye(n), "low rank": b @ b.T * 1e6, "close": q @ np.diag(1 + 1e-9 * np.arange(n)) @ q.T}[kind]
    v = (v + v.T) / 2
    w, u = W.leading(v, 4)
    assert len(w) == (min(n, 2) if kind == "low rank" else min(n, 4))
    assert np.allclose(w, np.linalg.eigvalsh(v)[::-1][: len(w)], rtol=1e-13)
    assert np.abs(v @ u.T - u.T * w).max() <= 1e-13 * np.abs(v).max()
    assert np.abs(u @ u.T - np.eye(len(w))).max() < 1e-14


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    values = np.linalg.eigvalsh(t)
    for x in np.linspace(-4, 4, 41):
        assert W.below(d, e, float(x), 1e-300) == int((values < x).sum())
