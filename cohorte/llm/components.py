"""Connected components of links kept in a table (distributed union-find).

Every partition first unites its own links with a local union-find, which
leaves one link a node. If few are left, one task unites those. The rest
alternates two contractions until nothing changes: each node hangs its larger neighbours on its least neighbour, then
its smaller neighbours. Both are a ``min`` aggregate (combined map-side, so a
node with a third of all links is no hot group) and a join on the node, which
adaptive execution splits where it is skewed. Links never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import dropped, written

LINKS = "a long, b long"
#: Links that one task unites at most (about 100 MB).
FEW = 300_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's link to the least node that the links of this partition connect it with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= 2_000_000:  # bounded memory: pass on what is united so far
            yield _links(parent, root)
            parent.clear()
    yield _links(parent, root)


def _links(parent: dict[int, int], root) -> pa.RecordBatch:
    nodes = [x for x in parent if parent[x] != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """Links ``a, b`` (long) to one row per linked node: ``node, component``,
    the component being its least node. Nodes without a link to another node
    don't appear; repeated links, loops and an empty table are fine."""
    now = written(links.filter("a <> b").mapInArrow(_united, LINKS), "links")
    state = _state(now)
    if state[0] <= few:
        return now.coalesce(1).mapInArrow(_united, "node long, component long")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = large.union(least.filter("a <> m").select("a", F.col("m").alias("b")))
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(links: DataFrame) -> tuple[int, int, int]:
    """Count and two sums of hashes: the same for the same set of links."""
    low = F.lit((1 << 40) - 1)  # sums of 40 bits don't overflow
    return tuple(links.agg(F.count("*"), *(F.coalesce(F.sum(F.xxhash64("a", "b", F.lit(k)).bitwiseAND(low)), F.lit(0)) for k in (1, 2))).first())
