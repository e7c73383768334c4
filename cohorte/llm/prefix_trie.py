"""Conversation prefix trie with a count-min screen.

Every conversation is rebuilt: it starts with the first ``h`` turns of its block's
first conversation and goes on with its own turns after its first ``h``. Each
distinct prefix of a rebuilt conversation is a node of the trie.

A turn is known by 128 bits of the SHA-256 of its role and text, a prefix by the
sum of its turns' hashes, each mixed with its depth; texts are read once and
never shuffled. A count-min sketch over all prefixes is filled first. Counters
only grow, so an estimate of one proves that no other conversation has the
prefix: such nodes are final where they lie. Only prefixes with a higher
estimate shuffle and are counted exactly; a false alarm costs a row, no result.

What a node says of its subtree follows from its members. A conversation adds one
leaf if it is the smallest member of a childless end. It saves the words of
the nodes that it isn't the smallest member of; these are the first ones of its
path, as members only leave on the way down. With ``T`` the words of its path up
to the last such node and ``W`` those above the node at hand, it saves
``max(0, T - W)`` there.

Nothing is held per conversation: rows lie in ranges of (conversation, turn), each
range counts by itself, and what a conversation brings over from the ranges before
(one row per range) is added after. Frequent prefixes are combined before the
shuffle, and joined by broadcast within a bound. The SHA-256 of a node's ends is
fed from blocks of ids in order; it is the one step that works in sequence per
node, on a few bytes per conversation.

Null roles and texts are empty. A null turn comes first; turns that tie stand in
the order of their digest, repeated rows are repeated turns. Rows without
``conv_id`` take no part. Ids below 0 have blocks towards 0, as ``%`` has. Long
texts cost their length once. Other columns are ignored. An empty table has no
trie: the result is empty.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorte.llm.common import WORD, dropped, written
from cohorte.llm.skew import batch_of, in_order, merged_by_key, partition_id, run_starts, weighted_join

#: Conversations of a block share the turns of its first.
BLOCK = 20
#: Turns taken from there: crc32 of the id, modulo this.
HEADS = 4
#: Counters of the sketch: rows, and cells a row at least and at most. Wider for more prefixes, up to 12 MB in all; beyond, more prefixes shuffle.
ROWS, LEAST_CELLS, MOST_CELLS = 3, 1 << 16, 1 << 24
#: Cells of one piece of the sketch.
PIECE = 1 << 16
#: Ids of one block that a node's digest is fed with.
IDS = 4096

ROOT = b"\0" * 16
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public domain), on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_hashes(digests: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words per turn from its digest (n x 2) and its depth."""
    step = depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(digests[:, 0] ^ _mix(step)), _mix(digests[:, 1] ^ _mix(step + np.uint64(1)))


# -- positions ---------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place within conversation (``idx``) and block (``nb``: turns of the first conversation so far), counted within this partition."""
    part = partition_id()
    conv = block = None
    n_conv = n_base = 0
    for b in batches:
        if not b.num_rows:
            continue
        convs, blocks = b.column("conv_id").to_numpy(), b.column("block").to_numpy()
        own = b.column("own").to_numpy(zero_copy_only=False)
        at = np.arange(len(convs))
        starts = run_starts(convs)
        idx = at - starts
        if convs[0] == conv:
            idx[starts == 0] += n_conv
        base = np.cumsum(~own)
        starts = run_starts(blocks)
        nb = base - np.where(starts > 0, base[starts - 1], 0)
        if blocks[0] == block:
            nb[starts == 0] += n_base
        conv, n_conv, block, n_base = convs[-1], int(idx[-1]) + 1, blocks[-1], int(nb[-1])
        yield batch_of(
            part=pa.array(np.full(len(convs), part), pa.int32()),
            conv_id=b.column("conv_id"),
            block=b.column("block"),
            own=b.column("own"),
            idx=pa.array(idx, pa.int64()),
            nb=pa.array(np.minimum(nb, HEADS - 1), pa.int64()),
            g=b.column("g"),
            words=b.column("words"),
        )


def _brought_positions(numbered: DataFrame) -> DataFrame:
    """Per partition: the conversation and block it goes on with, and their turns before (one row per partition through the driver)."""
    spark = numbered.sparkSession
    last = F.max(F.struct("block", "own", "conv_id", "idx", "nb")).alias("last")
    rows, conv, n_conv, block, n_base = [], None, 0, None, 0
    for r in numbered.groupBy("part").agg(last).orderBy("part").collect():
        rows.append((r["part"], conv, n_conv, block, n_base))
        z = r["last"]
        n_conv = z["idx"] + 1 + (n_conv if z["conv_id"] == conv else 0)
        n_base = z["nb"] + (n_base if z["block"] == block else 0)
        conv, block = z["conv_id"], z["block"]
    return spark.createDataFrame(rows, "part int, b_conv long, b_n long, b_block long, b_nb long")


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        (c - c % BLOCK).alias("block"),
        (c % BLOCK != 0).alias("own"),
        c.alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)).alias("g"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("copy"),  # spreads equal rows over ranges
    )
    # written first: finding the ranges reads the rows once more, and texts are to be hashed once
    rows = written(rows, "hashed")
    sorted_rows = in_order(rows, "block", "own", "conv_id", "turn", "g", "copy")
    return sorted_rows.select("conv_id", "block", "own", "g", "words").mapInArrow(
        _numbered, "part int, conv_id long, block long, own boolean, idx long, nb long, g binary, words long"
    )


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``conv_id, depth, g, words``), all conversations, and those without turns."""
    at = numbered.join(F.broadcast(_brought_positions(numbered)), "part").select(
        "conv_id",
        "block",
        "own",
        "g",
        "words",
        (F.col("idx") + F.when(F.col("conv_id") == F.col("b_conv"), F.col("b_n")).otherwise(0)).alias("pos"),
        F.least(F.lit(HEADS - 1), F.col("nb") + F.when(F.col("block") == F.col("b_block"), F.col("b_nb")).otherwise(0)).alias("nb"),
        F.when(F.col("own"), head_turns(F.col("conv_id"))).otherwise(0).alias("h"),
    )
    first = at.filter("pos = 0").select("conv_id", "block", "own", "h")
    tails = at.filter(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.least("h", "nb") + 1).alias("depth"), "g", "words")
    heads = at.filter(~F.col("own") & (F.col("pos") < HEADS - 1)).select("block", "pos", "g", "words")
    # at most 3 turns and 39 conversations a block
    taken = first.filter("h > 0").join(heads, "block").filter(F.col("pos") < F.col("h")).select("conv_id", (F.col("pos") + 1).alias("depth"), "g", "words")
    none = at.filter("nb = 0 AND pos <= h AND h > 0").groupBy("conv_id", "h").agg(F.max("pos").alias("pos")).filter("pos < h").select("conv_id")
    return tails.unionByName(taken), first.select("conv_id"), none


# -- prefixes ----------------------------------------------------------------


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with the sums of their hashes and words so far (``a, b``, ``w`` with and ``pa, pb, pw`` without the turn), within this partition; ``is_end`` is null for its last row."""
    part = partition_id()
    conv = None
    a0 = b0 = np.uint64(0)
    w0 = 0
    held: pa.RecordBatch | None = None

    def out(batch: pa.RecordBatch, following: int | None) -> pa.RecordBatch:
        convs = batch.column("conv_id").to_numpy()
        after = np.append(convs[1:], -1 if following is None else following)
        ends = pa.array(convs != after, pa.bool_(), mask=np.arange(len(convs)) == (len(convs) - 1 if following is None else -1))
        return pa.RecordBatch.from_arrays([*batch.columns, ends], names=[*batch.schema.names, "is_end"])

    for x in batches:
        if not x.num_rows:
            continue
        convs, depth, words = (x.column(c).to_numpy() for c in ("conv_id", "depth", "words"))
        digests = np.frombuffer(b"".join(x.column("g").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        ha, hb = turn_hashes(digests, depth)
        starts = run_starts(convs)
        sums = []
        for values, before in ((ha, a0), (hb, b0), (words, w0)):
            run = np.cumsum(values, dtype=values.dtype)
            run = run - np.where(starts > 0, run[starts - 1], values.dtype.type(0))
            if convs[0] == conv:
                run[starts == 0] += before
            sums.append(run)
        conv, a0, b0, w0 = convs[-1], sums[0][-1], sums[1][-1], sums[2][-1]
        signed = lambda v: pa.array(v.view(np.int64))
        now = batch_of(
            part=pa.array(np.full(len(convs), part), pa.int32()),
            conv_id=x.column("conv_id"),
            depth=x.column("depth"),
            a=signed(sums[0]),
            b=signed(sums[1]),
            pa=signed(sums[0] - ha),
            pb=signed(sums[1] - hb),
            words=x.column("words"),
            w=pa.array(sums[2]),
        )
        if held is not None:
            yield out(held, int(convs[0]))
        held = now
    if held is not None:
        yield out(held, None)


_SUMMED = "part int, conv_id long, depth long, a long, b long, pa long, pb long, words long, w long, is_end boolean"


def _brought_sums(summed: DataFrame) -> dict[int, tuple[int, int, int, int, bool]]:
    """Per partition: conversation it goes on with, sums before, and whether its last row ends a conversation (one row per partition through the driver)."""
    parts = summed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "a", "b", "w")).alias("last")).orderBy("part").collect()
    out = {}
    conv, a, b, w = -1, 0, 0, 0
    for i, r in enumerate(parts):
        z = r["last"]
        ends = i + 1 == len(parts) or parts[i + 1]["first"] != z["conv_id"]
        out[r["part"]] = (conv, a, b, w, ends)
        same = i > 0 and z["conv_id"] == conv
        a, b, w = (_signed(z["a"] + (a if same else 0)), _signed(z["b"] + (b if same else 0)), z["w"] + (w if same else 0))
        conv = z["conv_id"]
    return out


def _completed(x: pa.RecordBatch, brought: dict) -> dict[str, np.ndarray]:
    """The columns of a batch with what its partitions brought over added."""
    col = {n: x.column(n).to_numpy(zero_copy_only=False) for n in ("part", "conv_id", "depth", "a", "b", "pa", "pb", "words", "w")}
    col = {n: v.copy() for n, v in col.items()}
    ends = x.column("is_end")
    col["is_end"] = ends.fill_null(False).to_numpy(zero_copy_only=False).copy()
    last = ends.is_null().to_numpy(zero_copy_only=False)
    for part in np.unique(col["part"]):
        conv, a, b, w, closes = brought[int(part)]
        mine = col["part"] == part
        col["is_end"][mine & last] = closes
        mine &= col["conv_id"] == conv
        if mine.any():
            for n, add in (("a", a), ("pa", a), ("b", b), ("pb", b)):
                col[n][mine] = (col[n][mine].view(np.uint64) + np.uint64(add & _MASK)).view(np.int64)
            col["w"][mine] += w
    return col


# -- sketch ------------------------------------------------------------------


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Cell of each prefix in each row of the sketch (ROWS x n)."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return np.stack([((a + np.uint64(r) * b) >> np.uint64(7)) & np.uint64(width - 1) for r in range(ROWS)]).astype(np.int64)


def _sketched(brought: dict, width: int):
    """Counters that stop at two, as pieces of two bits a cell; empty pieces are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = partition_id()
        counts = np.zeros((ROWS, width), np.uint8)
        for x in batches:
            if x.num_rows:
                col = _completed(x, brought)
                for row, cells in enumerate(_cells(col["a"], col["b"], width)):
                    at, n = np.unique(cells, return_counts=True)
                    counts[row, at] = np.minimum(2, counts[row, at] + np.minimum(n, 2))
        pieces = counts.reshape(-1, min(PIECE, width))
        used = np.flatnonzero(pieces.any(axis=1))
        for i in used:
            yield batch_of(part=pa.array([part], pa.int32()), piece=pa.array([int(i)], pa.int32()), data=pa.array([_packed(pieces[i])], pa.binary()))

    return run


def _packed(counts: np.ndarray) -> bytes:
    bits = np.packbits(np.concatenate([counts >= 1, counts >= 2]))
    return zlib.compress(bits.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(2, -1)
    return bits[0] + bits[1]


def _added(held: bytes | None, data: bytes) -> bytes:
    return data if held is None else _packed(np.minimum(2, _unpacked(held) + _unpacked(data)))


class Sketch:
    """Tells which prefixes may be shared: the least of a prefix's counters is two."""

    def __init__(self, pieces: dict[int, bytes], width: int) -> None:
        self.width = width
        size = min(PIECE, width)
        shared = np.zeros((ROWS * width // size, size), bool)
        for i, data in pieces.items():
            shared[i] = _unpacked(data) >= 2
        self.bits = np.packbits(shared.reshape(ROWS, width), axis=1)

    def may_be_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for row, cells in enumerate(_cells(a, b, self.width)):
            out &= (self.bits[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out


#: Kinds of prefixes: proven alone; alone, under a prefix that may be shared; maybe shared.
ALONE, TAIL, SHARED = 1, 2, 3


def _screened(brought: dict, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            col = _completed(x, brought)
            own = sketch.value.may_be_shared(col["a"], col["b"])
            above = (col["depth"] == 1) | sketch.value.may_be_shared(col["pa"], col["pb"])
            kind = np.where(own, SHARED, np.where(above, TAIL, ALONE))
            pair = lambda a, b: np.stack([col[a], col[b]], axis=1).astype(">i8").tobytes()
            digest, parent = pair("a", "b"), pair("pa", "pb")
            keep = lambda raw, mask: pa.array([raw[16 * i : 16 * i + 16] if m else None for i, m in enumerate(mask)], pa.binary())
            yield batch_of(
                conv_id=pa.array(col["conv_id"]),
                depth=pa.array(col["depth"]),
                kind=pa.array(kind, pa.int32()),
                digest=keep(digest, own),
                parent=keep(parent, above & (kind != ALONE)),
                words=pa.array(col["words"]),
                w=pa.array(col["w"]),
                is_end=pa.array(col["is_end"]),
            )

    return run


def screened(summed: DataFrame) -> DataFrame:
    """All prefixes with their kind; digests where a prefix may be shared."""
    sc = summed.sparkSession.sparkContext
    brought = _brought_sums(summed)
    width = 1 << min(max(math.ceil(math.log2(4 * max(summed.count(), 1))), LEAST_CELLS.bit_length() - 1), MOST_CELLS.bit_length() - 1)
    pieces = summed.mapInArrow(_sketched(brought, width), "part int, piece int, data binary")
    merged = merged_by_key(pieces, "piece", _added, max(len(brought), sc.defaultParallelism))
    sketch = sc.broadcast(Sketch({r["piece"]: bytes(r["data"]) for r in merged.collect()}, width))  # bounded by MOST_CELLS
    return summed.mapInArrow(_screened(brought, sketch), "conv_id long, depth long, kind int, digest binary, parent binary, words long, w long, is_end boolean")


# -- digests of ends -----------------------------------------------------------


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, id) rows as blocks of comma-joined ids: ``digest, start`` (first id)``, ids``."""
    key, ids = None, []

    def block() -> pa.RecordBatch:
        return batch_of(digest=pa.array([key], pa.binary()), start=pa.array([ids[0]], pa.int64()), ids=pa.array([",".join(map(str, ids))]))

    for x in batches:
        for d, i in zip(x.column("digest").to_pylist(), x.column("conv_id").to_pylist(), strict=True):
            if ids and (d != key or len(ids) == IDS):
                yield block()
                ids = []
            key = d
            ids.append(i)
    if ids:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's blocks, which come in order; holds one block at a time."""
    key, state = None, None
    done: list[tuple[bytes, str]] = []

    def out() -> pa.RecordBatch:
        return batch_of(digest=pa.array([d for d, _ in done], pa.binary()), ends_sha256=pa.array([s for _, s in done], pa.string()))

    for x in batches:
        for d, ids in zip(x.column("digest").to_pylist(), x.column("ids").to_pylist(), strict=True):
            if d == key:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = d, hashlib.sha256(ids.encode())
        yield out()
        done = []
    if state is not None:
        done.append((key, state.hexdigest()))
        yield out()


def ends_digests(ends: DataFrame) -> DataFrame:
    """``digest, ends_sha256`` of the ids (``digest, conv_id``) in ascending order."""
    blocks = in_order(ends, "digest", "conv_id").mapInArrow(_id_blocks, "digest binary, start long, ids string")
    ordered = blocks.repartition("digest").sortWithinPartitions("digest", "start").select("digest", "ids")
    return ordered.mapInArrow(_hashed, "digest binary, ends_sha256 string")


# -- trie ----------------------------------------------------------------------

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    numbered = written(_turns(conversations), "turns")
    turns, everyone, turnless = rebuilt(numbered)
    summed = written(in_order(turns, "conv_id", "depth").mapInArrow(_summed, _SUMMED), "prefixes")
    convs = everyone.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    turnless = written(turnless, "turnless")
    dropped(numbered)
    prefixes = written(screened(summed), "screened")
    dropped(summed)
    shared = prefixes.filter(F.col("kind") == SHARED)

    # exact grouping of what may be shared
    nodes = written(
        shared.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("least"),
            F.count_if("is_end").alias("n_ends"),
            F.first("depth").alias("depth"),
            F.first("parent").alias("parent"),
        ),
        "nodes",
    )
    size = nodes.agg(F.sum("n_convs").alias("members"), F.count(F.lit(1)).alias("n")).first()
    members = size["members"] or 0

    # what each conversation adds to the nodes above
    known = weighted_join(shared, nodes.select("digest", "least", "n_ends", "n_convs", F.col("n_convs").alias("weight")), "digest", "weight", members)
    adds = written(
        known.groupBy("conv_id").agg(
            F.coalesce(F.max(F.when(F.col("conv_id") != F.col("least"), F.col("w"))), F.lit(0)).alias("saves"),
            F.count(F.lit(1)).alias("weight"),
            F.coalesce(F.max(F.when(F.col("is_end"), (F.col("n_ends") == F.col("n_convs")) & (F.col("conv_id") == F.col("least")))), F.lit(True)).cast("long").alias("leaf"),
        ),
        "adds",
    )
    below = weighted_join(shared.select("digest", "conv_id", (F.col("w") - F.col("words")).alias("above")), adds, "conv_id", "weight", members)
    subtree = below.groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("saves") - F.col("above"))).alias("saved_tokens"))
    tails = prefixes.filter(F.col("kind") == TAIL)
    children = nodes.select("parent").unionByName(tails.select("parent")).filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    children = written(children, "children")
    ends = shared.filter("is_end").select("digest", "conv_id").unionByName(turnless.select(F.lit(b"root").alias("digest"), "conv_id"))
    ends = written(ends_digests(ends), "ends")
    full = written(
        nodes.join(subtree, "digest").join(children, "digest", "left").join(ends, "digest", "left").select("*", F.coalesce("n_children", F.lit(0)).alias("weight")).drop("n_children").withColumnRenamed("weight", "n_children"),
        "full",
    )

    # the root: all conversations, so no join
    total = adds.agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"), F.count(F.lit(1)).alias("n")).first()
    root_ends = turnless.count()
    alone = convs["n"] - root_ends - total["n"]
    top = children.filter(F.col("digest") == F.lit(ROOT)).select("n_children").first()
    digest = ends.filter(F.col("digest") == F.lit(b"root")).select("ends_sha256").first()
    leaves = (total["leaf"] or 0) + alone if convs["n"] > root_ends else 1
    root = (convs["least"], 0, None, convs["n"], top["n_children"] if top else 0, leaves, total["saves"] or 0, digest["ends_sha256"] if digest else NO_ENDS)
    spark = conversations.sparkSession
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    roots = spark.createDataFrame([root] if convs["n"] else [], schema)

    # parents: the root's id, a shared node's, or the only member itself
    single = [
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("is_end"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    ]
    lone = prefixes.filter(F.col("kind") == ALONE).select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single)
    exact = full.select(
        F.col("least").alias("conv_id"), "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
    found = exact.unionByName(tails.select("conv_id", "depth", "parent", *single))
    at_top = found.filter("depth = 1").withColumn("parent_conv_id", F.lit(convs["least"]).cast("long"))
    own = found.filter("depth > 1 AND parent IS NULL").withColumn("parent_conv_id", F.col("conv_id"))
    under = found.filter("depth > 1 AND parent IS NOT NULL")
    parents = full.select(F.col("digest").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    under = weighted_join(under, parents, "parent", "weight", (size["n"] or 0) + tails.count())
    out = roots
    for part in (lone, at_top, own, under):
        out = out.unionByName(part.select(*COLUMNS))
    return out


# CRC-32 of the id's digits, bit by bit (SQL has no function for it)
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)),
  lambda s, x: list_reduce([xor(s, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

SQL = f"""
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos, d, words
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), conv AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS b, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE {_CRC} % 4 END AS h FROM turn
), joined AS (
  SELECT c, pos, 0 AS own, d, words FROM conv JOIN turn t ON t.conv_id = b AND pos < h
  UNION ALL
  SELECT c, pos, 1, d, words FROM conv JOIN turn t ON t.conv_id = c AND pos >= h
), path AS (
  SELECT c, row_number() OVER w AS depth, string_agg(d, '/') OVER w AS p, words FROM joined WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT c, 0, '', 0 FROM conv
), member AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY c) AS is_end, lag(p) OVER (PARTITION BY c ORDER BY depth) AS parent FROM path
), node AS (
  SELECT p, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN is_end THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM member GROUP BY p
), family AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM node x WHERE x.parent = n.p) AS n_children
  FROM node n LEFT JOIN node up ON up.p = n.parent
), below AS (
  SELECT a.p, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM family u JOIN member a ON a.c = u.conv_id AND a.depth <= u.depth GROUP BY a.p
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM family JOIN below USING (p)"""
