"""Nearest neighbours by cosine: a block matrix join of int8 tiles.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own.
Candidates are dealt into shares, one a task and each about as many rows; the
queries go to every share. A task holds its candidates in blocks of BLOCK rows
and takes the queries by ASKED; each pair of blocks is one tile, and a tile's
cosines are one matrix product of the rounded forms with a bound on its error.
With q the query and c the candidate, both of length 1, and their rounded forms
off by vectors of length e_q and e_c,

    |q.c - q'.c'| <= e_q |c'| + e_c

so in each tile only candidates whose upper bound reaches the query's K-th best
lower bound, or its K-th best cosine of the tiles before, can matter. Those are
computed again in double precision from the original vectors. A query's best are
merged over the tiles of a task, by a window with a limit of K over the tasks.
The result is exact.

What moves is every candidate once and a query once a share. Nothing goes to
the driver but two totals. A task holds its share of the candidates and one
block of queries: there are SHARES shares, more if a share went beyond HELD
bytes, so a task is bounded whatever the number of vectors. A frequent vector
or id is spread over the shares. Vectors that are null, empty, zero, or hold
null or non-finite components take no part; vectors of different length are not
compared; neither are rows without ``vec_id``. Repeated rows of an id are one
vector; with several vectors under one id, the result holds the nearest. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Candidates and queries of a block, at most.
BLOCK, ASKED = 4096, 512
#: Queries are the rows whose id this divides.
EVERY = 50
#: Shares of the candidates, and about the bytes of one in a task (12 a component at most).
SHARES, HELD = 64, 256 << 20
#: Components of a block at most, and of the pairs that are computed again at once (they stay in the cache).
COMPONENTS, AT_ONCE = 1 << 21, 1 << 17
#: Classes of a block's columns whose maxima stand for them when a query's first bound is sought.
RUNS = 256

_USABLE = "vec_id long, dim int, v binary"
_FOUND = "query_id long, vec_id long, score double"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as little-endian floats (of four bytes if they came so), equal rows of a batch once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, lists = batch.columns
        kind = np.dtype("<f4" if pa.types.is_float32(lists.type.value_type) else "<f8")
        x = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
        at = lists.offsets.to_numpy().astype(np.int64)
        unfit, used = (np.concatenate([[0], np.cumsum(flags)])[at] for flags in (~np.isfinite(x), x != 0))
        good = pa.array((np.diff(unfit) == 0) & (np.diff(used) > 0) & ids.is_valid().to_numpy(False) & lists.is_valid().to_numpy(False))
        v = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(x)])
        rows = pa.table({"vec_id": ids, "dim": pa.array(np.diff(at), pa.int32()), "v": v}).filter(good)
        yield from rows.group_by(["vec_id", "dim", "v"], use_threads=False).aggregate([]).to_batches()


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow or underflow of the squares."""
    top = np.abs(v).max(axis=1)
    return top * np.sqrt(np.square(v / top[:, None]).sum(axis=1))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: ids and vectors, and the int8 form with its scale and error."""
    rows = rows.sort_values(["vec_id"], kind="stable")
    dim = int(rows["dim"].iloc[0])
    joined = b"".join(rows["v"])
    v = np.frombuffer(joined, _kind(joined, len(rows), dim)).reshape(-1, dim).astype(np.float64)
    norm = norms(v)
    unit = v / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    slack = np.sqrt(np.square(unit - codes * scale[:, None]).sum(axis=1)) + 1e-9
    return pd.DataFrame(
        {
            "dim": [dim],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "vectors": [joined],
            "codes": [codes.tobytes()],
            "scale": [scale.tobytes()],
            "slack": [slack.tobytes()],
            "norm": [norm.tobytes()],
        }
    )


def _kind(vectors: bytes, rows: int, dim: int) -> str:
    return "<f4" if len(vectors) == 4 * rows * dim else "<f8"


class Block:
    def __init__(self, row: dict) -> None:
        dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], _kind(row["vectors"], len(self.ids), dim)).reshape(-1, dim)
        #: Vectors under one id, at most.
        self.most = int(np.unique(self.ids, return_counts=True)[1].max())
        self.scale, self.slack, self.norm = (np.frombuffer(row[c], np.float64) for c in ("scale", "slack", "norm"))
        #: The rounded vectors, and a column for what a tile adds to its products.
        self.wide = np.zeros((len(self.ids), dim + 1), np.float32)
        self.wide[:, :dim] = np.frombuffer(row["codes"], np.int8).reshape(-1, dim)
        self.wide[:, :dim] *= self.scale[:, None].astype(np.float32)


def _least(high: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """For each row of ``high - off`` a number that at least ``n`` entries reach, close to the ``n``-th largest."""
    if len(off) >= 2 * RUNS and n <= RUNS // 8:
        whole = len(off) // RUNS * RUNS
        high, off = high[:, :whole].reshape(len(high), -1, RUNS).max(axis=1), off[:whole].reshape(-1, RUNS).max(axis=0)
    if len(off) <= n:
        return np.full(len(high), -np.inf)
    return np.partition(high - off, len(off) - n, axis=1)[:, len(off) - n].astype(np.float64)


def _places(flags: np.ndarray) -> np.ndarray:
    """Places of the true ones, of which there are few: whole words first."""
    flags = flags.reshape(-1)
    if len(flags) % 8:
        return np.flatnonzero(flags)
    word = np.flatnonzero(flags.view(np.uint64))
    at = np.flatnonzero(flags.reshape(-1, 8)[word])
    return word[at >> 3] * 8 + (at & 7)


def tile(q: Block, c: Block, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Each query's ``k`` nearest of one tile, as (-cosine, id), nearest first.

    ``floor``: a cosine for each query's row below which none matters; -inf if there is none yet.
    """
    dim = q.vectors.shape[1]
    floor = np.full(len(q.ids), -np.inf) if floor is None else floor.copy()
    reach = 1 + q.slack.max()
    # products of single precision: an error in each of dim + 1 terms, and of their factors
    noise = (dim + 8) * 2.0**-23 * reach * (1 + 2 * c.slack.max())
    lift = np.nextafter((c.slack * reach).astype(np.float32), np.float32(np.inf))
    c.wide[:, -1] = lift
    asking = q.wide.copy()
    asking[:, -1] = 1
    high = asking @ c.wide.T  # upper bounds, but for the query's slack and the noise
    first, last = (np.searchsorted(c.ids, q.ids, side) for side in ("left", "right"))
    for i in np.flatnonzero(last > first):  # of its own id
        high[i, first[i] : last[i]] = -np.inf
    n = k * c.most
    begun = np.isneginf(floor)
    if begun.any():
        floor[begun] = _least(high if begun.all() else high[begun], 2 * lift, n) - q.slack[begun] - 2 * noise
    cut = np.nextafter((floor - q.slack - noise).astype(np.float32), np.float32(-np.inf))
    i, j = np.divmod(_places(high >= cut[:, None]), len(c.ids))
    other = q.ids[i] != c.ids[j]
    i, j = i[other], j[other]
    unit = q.vectors / q.norm[:, None]
    score = np.empty(len(i))
    step = max(1, AT_ONCE // dim)
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        # row by row, so equal vectors get equal scores
        score[at : at + step] = (c.vectors[y] / c.norm[y, None] * unit[x]).sum(axis=1)
    near = score >= floor[i]
    i, j, score = i[near], j[near], score[near]
    order = np.lexsort((c.ids[j], -score, i))
    far, ids = (-score[order]).tolist(), c.ids[j[order]].tolist()
    ends = np.searchsorted(i[order], np.arange(len(q.ids) + 1)).tolist()
    for query, at, end in zip(q.ids.tolist(), ends, ends[1:]):
        if at < end:
            found = list(zip(far[at : min(at + n, end)], ids[at:end]))
            yield query, found if c.most == 1 else merged(k, found, [])


def merged(k: int, a: list[tuple[float, int]], b: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """The ``k`` first of two sorted lists, an id only once."""
    out: list[tuple[float, int]] = []
    seen: set[int] = set()
    for x in sorted(a + b):
        if x[1] not in seen:
            seen.add(x[1])
            out.append(x)
            if len(out) == k:
                break
    return out


def _pieces(batches: Iterator[pa.RecordBatch], block: int, asked: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Sorted rows as ((share, dim, query), rows of a block at most)."""
    key, rest = None, None
    for batch in batches:
        for now, rows in batch.to_pandas().groupby(["share", "dim", "query"]):
            if key is not None and now != key:
                yield key, rest
                rest = None
            key, rest = now, rows if rest is None else pd.concat([rest, rows])
            most = max(1, min(asked if key[2] else block, COMPONENTS // key[1]))
            while len(rest) > most:
                yield key, rest.iloc[:most]
                rest = rest.iloc[most:]
    if key is not None:
        yield key, rest


def _distinct(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each row once, and of equal vectors the ``k + 1`` smallest ids.

    They tie for every query, so ``k`` of those ids come before any other.
    """
    rows = rows.drop_duplicates(["vec_id", "v"]).sort_values("vec_id")
    return rows[rows.groupby("v").cumcount() <= k]


def _tiles(k: int, block: int, asked: int):
    def block_of(rows: pd.DataFrame) -> Block:
        return Block(_pack(rows).to_dict("records")[0])

    def best_of(q: Block, held: list[Block]) -> pa.RecordBatch:
        best: dict[int, list[tuple[float, int]]] = {}
        floor = np.full(len(q.ids), -np.inf)
        for c in held:
            for query, found in tile(q, c, k, floor):
                best[query] = merged(k, best[query], found) if query in best else found
            floor = np.array([-best[i][-1][0] if len(best.get(i, ())) == k else -np.inf for i in q.ids.tolist()])
        rows = [(i, c, -s) for i, found in best.items() for s, c in found]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for (share, dim, query), rows in _pieces(batches, block, asked):
            if here != (share, dim):
                here, held = (share, dim), []
            if not query:
                held.append(block_of(_distinct(rows, k)))
            elif held:
                yield best_of(block_of(rows.drop_duplicates(["vec_id", "v"])), held)

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of every query (``vec_id`` divisible by ``every``)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    count, components = rows.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()
    shares = max(1, min(math.ceil(count / block), SHARES), math.ceil(12 * (components or 0) / HELD))
    usable = rows.mapInArrow(_prepared, _USABLE)
    queries = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_prepared, _USABLE)
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shares)).cast("int")
    candidates = usable.select(own.alias("share"), "dim", F.lit(False).alias("query"), "vec_id", "v")
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "dim", F.lit(True).alias("query"), "vec_id", "v")
    # a share is a partition; its candidates come before the queries
    dealt = candidates.unionByName(asking).repartitionById(shares, F.col("share")).sortWithinPartitions("share", "dim", "query")
    found = dealt.mapInArrow(_tiles(k, block, asked), _FOUND)
    per_id = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return per_id.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), near AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e)))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM near QUALIFY rank <= 5"""
