import numpy as np

from cohorte.llm.neighbours import RUNS, Block, _least, _pack, _places, merged, nearest, tile
import pandas as pd


def brute(rows, k=5, every=50):
    """Cosine in double precision, ties to the smaller id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = out.setdefault(q, {})
            for c, y in good:
                if c != q and len(x) == len(y):
                    s = float((x / np.linalg.norm(x) * (y / np.linalg.norm(y))).sum())
                    best[c] = max(best.get(c, -2), s)
    return {q: sorted(((-round(s, 9), c) for c, s in b.items()))[:k] for q, b in out.items() if b}


def as_found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.rank, -round(r.score, 9), r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(s, c) for _, s, c in sorted(v)] for q, v in out.items()}


def test_error_bound_keeps_every_neighbour():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 24))
    rows = pd.DataFrame({"vec_id": np.arange(400), "dim": 24, "block": 0, "v": [x.tobytes() for x in v]})
    b = Block(_pack(rows).to_dict("records")[0])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q, found in tile(b, b, 5):
        s = unit @ unit[q]
        s[q] = -2
        assert [c for _, c in found] == np.argsort(-s, kind="stable")[:5].tolist()


def test_merged_heaps():
    assert merged(3, [(-0.9, 1), (-0.5, 2)], [(-0.9, 0), (-0.9, 1), (-0.4, 7)]) == [(-0.9, 0), (-0.9, 1), (-0.5, 2)]


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [(i, rows[7][1], "x") for i in range(300, 420)]  # one vector, many ids
    rows += [(450, rows[7][1], "x"), (451, rows[7][1], "x"), (451, rows[8][1], "x"), (50, rows[50][1], "x")]  # ties, two vectors, a repeated row
    rows += [(500, None, "x"), (501, [0.0] * 8, "x"), (502, [1.0, None] * 4, "x"), (503, [float("nan")] * 8, "x"), (504, [float("inf")] * 8, "x"), (505, [], "x"), (None, rows[1][1], "x")]
    rows += [(550, [1.0, 2.0], "x"), (551, [2.0, 1.0], "x"), (600, [1.0, 2.0, 3.0], "x")]  # other lengths
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(5)
    got = as_found(nearest(docs, block=64, asked=4).collect())
    assert got == brute([(i, v) for i, v, _ in rows])
    assert 550 in got and 600 not in got  # no candidate of its length
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_no_block_goes_through_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 8)).astype(np.float32))]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), block=64, asked=4)
    assert as_found(found.collect()) == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # it held every query once a block of candidates


def test_near_copies_and_copies_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 12))
    v = centres[rng.integers(0, 3, 900)] + 3e-3 * rng.normal(size=(900, 12))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(i, rows[100][1]) for i in range(900, 1300)]  # copies with ids of their own
    rows += [(151, rows[i][1]) for i in range(200, 260)]  # an id with many vectors
    rows += [(7, rows[7][1])] * 200 + [(None, rows[3][1])]  # a row that comes again
    rows += [(-50, rows[1][1]), (-7, rows[100][1])]
    for kind in ("float", "double"):
        cut = [(i, np.array(x, np.float32).tolist() if kind == "float" else x) for i, x in rows]
        table = spark.createDataFrame(cut, f"vec_id long, embedding array<{kind}>").repartition(3)
        assert as_found(nearest(table, block=100, asked=7).collect()) == brute(list({(i, tuple(x)): (i, x) for i, x in cut}.values()))


def test_floor_of_earlier_tiles():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 16))
    pack = lambda a, b: Block(_pack(pd.DataFrame({"vec_id": np.arange(a, b), "dim": 16, "v": [x.tobytes() for x in v[a:b]]})).to_dict("records")[0])
    q, first, then = pack(0, 40), pack(0, 1500), pack(1500, 3000)
    best = dict(tile(q, first, 5))
    floor = np.array([-best[i][-1][0] for i in range(40)])
    for i, found in tile(q, then, 5, floor):
        assert all(-s >= floor[i] for s, _ in found)
        best[i] = merged(5, best[i], found)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(40):
        s = unit @ unit[i]
        s[i] = -2
        assert [c for _, c in best[i]] == np.argsort(-s, kind="stable")[:5].tolist()


def test_first_bound_is_reached_by_enough_entries():
    rng = np.random.default_rng(8)
    for columns in (1, 9, 300, 2 * RUNS, 5 * RUNS + 17):
        high, off = rng.normal(size=(6, columns)).astype(np.float32), rng.random(columns).astype(np.float32)
        high[2, 5:] = -np.inf
        for n in (1, 5, 40, 700):
            least = _least(high, off, n)
            assert ((high - off >= least[:, None]).sum(axis=1) >= min(n, columns)).all()


def test_places_of_flags():
    rng = np.random.default_rng(9)
    for shape in ((3, 5), (4, 8), (50, 64), (7, 200)):
        for share in (0, 0.01, 0.5, 1):
            flags = rng.random(shape) < share
            assert _places(flags).tolist() == np.flatnonzero(flags).tolist()
