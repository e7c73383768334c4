import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from cohorte.llm import prefix_trie as P

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small partitions stay apart, so conversations go over several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def brute(rows):
    """Nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in turns.items():
        base = c - int(np.fmod(c, 20))
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(base, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in nodes}
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves = sum(out[k][5] for k in children[p]) if children[p] else 1
        saved = (len(nodes[p]) - 1) * words[p] + sum(out[k][6] for k in children[p])
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(paths[c]) == len(p))
        out[p] = (min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(out.values(), key=key)


def found(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "p", "d", "w") for r in rows], SCHEMA).repartition(parts)


def made(seed, n, texts=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-45, 120)
        for t in range(rng.randrange(longest)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), rng.choice(["a b", "", None, "c", *map(str, range(texts))])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 90)
    assert found(P.prefix_trie(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (None, 0, "user", "lost"),
        (40, None, None, None),
        (40, 1, "user", long),
        (41, 0, "user", "a"),
        (41, 0, "user", "a"),  # repeated row
        (41, 0, "user", "b"),  # tie
        (63, 0, "user", "short"),  # no first conversation: its turns are cut, none may remain
        (66, 0, "user", "short"),
        (-1, 2, "user", "é \n x"),
        (-20, 0, "assistant", "é"),
    ]
    assert found(P.prefix_trie(frame(spark, rows))) == brute(rows)


def test_one_conversation_and_one_copy_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 7)
    rows = [(20, t, "user", f"t{t % 5}") for t in range(3000)]  # goes over several ranges
    rows += [(c, t, "user", f"t{t}") for c in range(100, 900, 20) for t in range(4)]  # copies
    rows += [(21, t, "user", f"t{t % 5}") for t in range(2500)]
    got = found(P.prefix_trie(frame(spark, rows, 8)))
    assert got == brute(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = made(3, 60)
    monkeypatch.setattr(P, "LEAST_CELLS", 8)
    monkeypatch.setattr(P, "MOST_CELLS", 8)
    assert found(P.prefix_trie(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert found(P.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_estimate_of_one_is_a_proof():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-(2**62), 2**62, 4000) for _ in range(2))
    twice = np.arange(4000) < 500
    pieces = {}
    for part in (np.arange(4000), np.flatnonzero(twice)):
        cells = P._cells(a[part], b[part], 1 << 12)
        counts = np.zeros((P.ROWS, 1 << 12), np.uint8)
        for row in range(P.ROWS):
            np.add.at(counts[row], cells[row], 1)
        for i, piece in enumerate(np.minimum(counts, 2).reshape(-1, 1 << 12)):
            pieces[i] = P._added(pieces.get(i), P._packed(piece))
    marked = P.Sketch(pieces, 1 << 12).may_be_shared(a, b)
    assert marked[twice].all()
    assert (~marked[~twice]).sum() > 0
