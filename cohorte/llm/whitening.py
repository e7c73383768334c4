"""Embedding whitening: leading principal components, scaled to variance one.

Entries become whole numbers, ``x = floor(256 c)``, so sums and deviations are exact
and equal vectors are equal rows. The components are fitted on the distinct vectors.

1. Exact sums per dimension, then the covariance from centred vectors: each task
   adds up one matrix, and the rows of the matrices are merged on Spark.
2. The driver sees one matrix of ``dim x dim``, whatever the number of vectors
   (16 MB at 1,448 dimensions). Householder reflections make it tridiagonal. Sturm
   counts (eigenvalues below a number, from the signs of a recurrence) bisect the
   leading eigenvalues; inverse iteration gives their vectors, which are made
   orthogonal within clusters of close eigenvalues and turned back.
3. The components are broadcast, every row is projected, and the covariance of the
   projected fit list is compared with the identity.

Null vectors and those with null or non-finite entries take no part. Vectors of
different length are whitened apart, each length with its own fit; empty vectors
have no components and no rows. Components without variance (fewer distinct vectors
or dimensions than components) can't be scaled and are left out. Entries whose
whole number is beyond 64 bits count as the nearest one that fits; a deviation
beyond 64 bits is null. Repeated rows and rows without ``vec_id`` give rows like
others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import dropped, written
from cohorte.llm.skew import batch_of, merged_by_key, partition_id

COMPONENTS = 4
SCALE = 256
#: Vectors of a matrix product.
ROWS = 4096
_TOP = 2**63 - 1
#: Doubles from here on leave 64 bits.
_EDGE = float(2**63)
EPS = np.finfo(np.float64).eps


# -- eigenvectors --------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix (Householder)."""
    a = v.copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        top = np.abs(x[1:]).max(initial=0.0)
        u = np.zeros_like(x)
        if top:
            scaled = x / max(top, abs(x[0]))
            u = scaled
            u[0] += math.copysign(np.linalg.norm(scaled), scaled[0])
            u /= np.linalg.norm(u)
            block = a[k + 1 :, k + 1 :]
            p = 2 * (block @ u)
            w = p - (u @ p) * u
            block -= np.outer(u, w) + np.outer(w, u)
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * u * (u @ x)
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def turned_back(reflections: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the first matrix."""
    z = z.copy()
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        z[k + 1 :] -= 2 * u * (u @ z[k + 1 :])
    return z


def below(d: np.ndarray, e: np.ndarray, x: float, least: float) -> int:
    """Eigenvalues smaller than ``x``: negative terms of the Sturm recurrence."""
    count, q = 0, 1.0
    squares = np.concatenate([[0.0], e * e])
    for di, s in zip(d.tolist(), squares.tolist(), strict=True):
        q = di - x - s / q
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    radius = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = float((d - radius).min()), float((d + radius).max())
    size = max(abs(low), abs(high))
    least = max(EPS * EPS * size, np.finfo(np.float64).tiny)
    n, out = len(d), []
    for i in range(k):
        a, b = low - EPS * size, (out[-1] if out else high) + EPS * size
        while b - a > 2 * EPS * max(abs(a), abs(b)) + least:
            mid = (a + b) / 2
            if mid in (a, b):
                break
            if below(d, e, mid, least) >= n - i:
                b = mid
            else:
                a = mid
        out.append((a + b) / 2)
    return out


def solved(d: np.ndarray, e: np.ndarray, x: float, rhs: np.ndarray, least: float) -> np.ndarray:
    """``(T - x) z = rhs`` by elimination with row exchanges; tiny pivots are lifted."""
    n = len(d)
    diag, up, up2, z = (d - x).tolist(), [*e.tolist(), 0.0], [0.0] * n, rhs.tolist()
    low = e.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(diag[i]):
            f = diag[i] / low[i]
            diag[i], up[i], up2[i], nd, nu = low[i], diag[i + 1], up[i + 1], up[i] - f * diag[i + 1], -f * up[i + 1]
            diag[i + 1], up[i + 1] = nd, nu
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
        else:
            if abs(diag[i]) < least:
                diag[i] = least
            f = low[i] / diag[i]
            diag[i + 1] -= f * up[i]
            z[i + 1] -= f * z[i]
    for i in range(n - 1, -1, -1):
        if abs(diag[i]) < least:
            diag[i] = least
        rest = z[i]
        if i + 1 < n:
            rest -= up[i] * z[i + 1]
        if i + 2 < n:
            rest -= up2[i] * z[i + 2]
        z[i] = rest / diag[i]
        if abs(z[i]) > 1e150:  # only the direction matters
            z = [c * 1e-150 for c in z]
    return np.array(z)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues with variance, falling, and unit eigenvectors as rows."""
    n = len(v)
    k = min(k, n)
    size = float(np.abs(v).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((0, n))
    d, e, reflections = tridiagonal(v / size)
    values = leading_values(d, e, k)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0)))
    values = [x for x in values if x > n * EPS * norm]
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(13)
    cluster = 0
    for i, x in enumerate(values):
        if i and values[i - 1] - x > 1e-3 * norm:
            cluster = i
        z = rng.standard_normal(n)
        # equal eigenvalues are set apart by a few bits, so solving differs
        shift = x - (i - cluster) * 2 * EPS * norm
        for _ in range(6):
            z = solved(d, e, shift, z, EPS * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for other in vectors[cluster:i]:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
        vectors.append(z)
    out = np.array([turned_back(reflections, z) for z in vectors]).reshape(-1, n)
    for i in range(len(out)):  # rounding of the way back
        for j in range(i):
            out[i] -= (out[j] @ out[i]) * out[j]
        out[i] /= np.linalg.norm(out[i])
    return np.array(values) * size, out


# -- vectors -------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as little-endian 64-bit whole numbers."""
    for batch in batches:
        ids, sizes, out = [], [], []
        for i, v in zip(batch.column(0), batch.column(1), strict=True):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            c = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(c).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(c * SCALE)
            whole = np.where(np.abs(x) < _EDGE, x, 0.0).astype(np.int64)
            whole[x >= _EDGE] = _TOP
            whole[x <= -_EDGE] = -_TOP - 1
            ids.append(i.as_py())
            sizes.append(len(whole))
            out.append(whole.astype("<i8").tobytes())
        yield batch_of(vec_id=pa.array(ids, pa.int64()), dim=pa.array(sizes, pa.int32()), x=pa.array(out, pa.binary()))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column("x"), dim)


def _sums(dim: int):
    """Per task: count and exact sums per dimension, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for _, x in _slices(batches, dim):
            n += len(x)
            if np.abs(x.astype(np.float64)).max() * len(x) < 2.0**62:
                add = x.sum(axis=0).tolist()
            else:
                add = x.astype(object).sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, add, strict=True)]
        if n:
            yield batch_of(part=pa.array([partition_id()], pa.int32()), piece=pa.array([0], pa.int32()), data=pa.array([" ".join(map(str, [n, *sums])).encode()], pa.binary()))

    return run


def _add_sums(held: bytes | None, data: bytes) -> bytes:
    if held is None:
        return data
    return " ".join(str(int(a) + int(b)) for a, b in zip(held.split(), data.split(), strict=True)).encode()


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def _products(dim: int, mean: np.ndarray, turn: np.ndarray):
    """Per task: the rows of the sum of ``y y'`` over centred, turned vectors ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((turn.shape[0],) * 2)
        some = False
        for _, x in _slices(batches, dim):
            y = _centred(x, mean) @ turn.T
            total += y.T @ y
            some = True
        if some:
            for i, row in enumerate(total):
                yield batch_of(part=pa.array([partition_id()], pa.int32()), piece=pa.array([i], pa.int32()), data=pa.array([row.tobytes()], pa.binary()))

    return run


def _add_rows(held: bytes | None, data: bytes) -> bytes:
    return data if held is None else (np.frombuffer(held) + np.frombuffer(data)).tobytes()


_PIECES = "part int, piece int, data binary"


def covariance(fit: DataFrame, dim: int, n: int, mean: np.ndarray, turn: np.ndarray, tasks: int) -> np.ndarray:
    """Covariance of the fit list, centred and then turned by the rows of ``turn``."""
    merged = merged_by_key(fit.mapInArrow(_products(dim, mean, turn), _PIECES), "piece", _add_rows, tasks)
    rows = {r["piece"]: np.frombuffer(bytes(r["data"])) for r in merged.collect()}  # dim rows
    v = np.array([rows[i] for i in range(turn.shape[0])]) / n
    return (v + v.T) / 2


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n x - sum)^2``, exact."""
    reach = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, sums))
    if reach * reach * len(sums) <= _TOP:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    far = n * x.astype(object) - np.array(sums, object)
    exact = (far * far).sum(axis=1).tolist()
    return [v if v <= _TOP else None for v in exact]


def _projected(dim: int, n: int, sums: list[int], mean: np.ndarray, turn: np.ndarray, explained: list[float], error: float):
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dim):
            rows = len(x)
            if not rows:
                continue
            take = np.repeat(np.arange(rows), k)
            yield batch_of(
                vec_id=part.column("vec_id").take(pa.array(take)),
                component=pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                n=pa.array(np.full(rows * k, n), pa.int64()),
                deviation=pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(take)),
                whitened=pa.array((_centred(x, mean) @ turn.T).reshape(-1)),
                explained=pa.array(np.tile(explained, rows)),
                identity_error=pa.array(np.full(rows * k, error)),
            )

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row."""
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_whole, "vec_id long, dim int, x binary"), "whole")
    fit = written(rows.select("dim", "x").distinct(), "fit")
    tasks = max(len(fit.inputFiles()), 1)
    out = spark.createDataFrame([], RESULT)
    fitted = []
    for r in fit.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # lengths of vectors
        dim, own = r["dim"], fit.filter(F.col("dim") == r["dim"]).select("x")
        text = merged_by_key(own.mapInArrow(_sums(dim), _PIECES), "piece", _add_sums, tasks).first()["data"]
        n, *sums = map(int, bytes(text).split())
        mean = np.array([s / n for s in sums])
        v = covariance(own, dim, n, mean, np.eye(dim), tasks)
        values, axes = leading(v, components)
        if not len(values):
            continue
        turn = axes / np.sqrt(values)[:, None]
        explained = (values / np.trace(v)).tolist()
        white = covariance(own, dim, n, mean, turn, tasks)
        fitted.append((dim, n, sums, mean, turn, explained, float(np.abs(white - np.eye(len(values))).max())))
    dropped(fit)
    for dim, *model in fitted:
        mine = rows.filter(F.col("dim") == dim).select("vec_id", "x")
        out = out.unionByName(mine.mapInArrow(_projected(dim, *model), RESULT))
    return out
