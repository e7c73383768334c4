import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest

from cohorte.operators import asof as A
from cohorte.operators.order_stats import RANGE
from cohorte.plans import kpis as K

D0 = date(2020, 1, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def made(seed, n_left, n_right, hot):
    rng = random.Random(seed)
    pick = lambda: "P0" if rng.random() < hot else rng.choice([f"P{i}" for i in range(12)] + [None])
    day = lambda: rng.choice([None, *[D0 + timedelta(days=rng.randrange(60)) for _ in range(9)]])
    return [(i, pick(), day()) for i in range(n_left)], [(pick(), day(), rng.randrange(5)) for _ in range(n_right)]


def brute(left, right, back, within):
    by = defaultdict(list)
    for k, t, v in right:
        if k is not None and t is not None:
            by[k].append((t, v))
    out = []
    for i, k, t in left:
        near = [] if k is None or t is None else [(abs((u - t).days), v, u) for u, v in by[k] if (u <= t if back else u >= t)]
        near = [x for x in near if within is None or x[0] <= within]
        out.append((i, k, t, *(min(near)[1:] if near else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", [A.BACKWARD, A.FORWARD])
@pytest.mark.parametrize("within", [None, 3])
def test_equals_brute_force(spark, direction, within):
    left, right = made(7, 400, 300, 0.5)
    x = spark.createDataFrame(left, "i long, k string, t date")
    y = spark.createDataFrame(right, "k string, u date, v long")
    got = A.asof_join(x, y, "k", "t", "u", {"v": "v", "u": "u"}, direction, within)
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, direction == A.BACKWARD, within)


def test_empty_sides(spark):
    x = spark.createDataFrame([(1, "a", D0)], "i long, k string, t date")
    y = spark.createDataFrame([], "k string, u date, v long")
    assert A.asof_join(x, y, "k", "t", "u", {"v": "v"}).collect()[0]["v"] is None
    assert A.asof_join(x.limit(0), y, "k", "t", "u", {"v": "v"}).count() == 0


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    """A patient with most of all visits, half of them on one day: no range holds much of it."""
    hot = [(f"H{i}", "P0", D0 + timedelta(days=i % 400 if i % 2 else 7)) for i in range(6000)]
    rest = [(f"C{i}", f"P{1 + i % 200}", D0 + timedelta(days=i % 400)) for i in range(3000)]
    visits = spark.createDataFrame(hot + rest, "id_consulta string, id_paciente string, fecha_consulta date").repartition(8)
    labs = spark.createDataFrame([(f"P{i % 201}", D0 + timedelta(days=i), float(i), "PSA") for i in range(402)], "id_paciente string, fecha_muestra date, resultado_numerico double, tipo_prueba string")
    seen = {}
    real = A.written_ranges

    def watched(df, *keys):
        out = real(df, *keys)
        seen.update(Counter({r[RANGE]: r["n"] for r in out.groupBy(RANGE).agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}))
        return out

    monkeypatch.setattr(A, "written_ranges", watched)
    got = {r.id_consulta: r for r in K.visits_with_last_lab(visits, labs).collect()}
    assert len(got) == 9000 and len(seen) >= 6
    assert max(seen.values()) < 0.3 * sum(seen.values())  # the patient has two thirds
    assert got["H0"].fecha_resultado == D0 and got["H0"].dias_desde_resultado == 7
    assert got["H399"].fecha_resultado == D0 + timedelta(days=201)
