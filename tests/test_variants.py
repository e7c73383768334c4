import random

from cohorte.operators import variants as V
from cohorte.operators.graph import components


def names(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v, n in values.items() for _ in range(n)], "c string")
    return {r.valor: r.canonico for r in V.variant_map(df, ["c"], **kw).collect()}


def test_sex_abbreviations(spark):
    got = names(spark, {"M": 50, " masc. ": 3, "Masculino": 9, "MASCULINO": 2, "masculimo": 1, "F": 40, "fem": 2, "Femenino": 30, None: 4})
    assert {got[v] for v in ("M", " masc. ", "Masculino", "MASCULINO")} == {"Masculino"}
    assert {got[v] for v in ("F", "fem", "Femenino")} == {"Femenino"}
    assert got["masculimo"] == "Masculino"  # one of ten
    assert None not in got


def test_what_says_nothing_stays_apart(spark):
    got = names(spark, {"m": 5, "masculino": 5, "mujer": 5, "i": 9, "ii": 9, "iii": 9, "iv": 9, "tipo 1": 100, "tipo 2": 1, "casas": 10, "cases": 9, "mama": 99, "lama": 1})
    assert {k: v.lower() for k, v in got.items()} == {k: k for k in got}


def test_typing_errors_chain(spark):
    got = names(spark, {"contributivo": 1000, "contributvo": 50, "contribuvo": 3, "subsidiado": 400, "Subsidíado": 3, "susidiado": 7, "subsidiadoo": 1})
    assert {got[v] for v in ("contributivo", "contributvo", "contribuvo")} == {"Contributivo"}
    assert {got[v] for v in ("subsidiado", "Subsidíado", "susidiado", "subsidiadoo")} == {"Subsidiado"}


def test_typo_links_equal_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(300)}
    counts = {w: rng.choice([1, 5, 100]) for w in words}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if min(len(a), len(b)) >= 5 and counts[a] * 10 <= counts[b] and distance(a, b) == 1}
    df = spark.createDataFrame([("c", w, n) for w, n in counts.items()], "campo string, clave string, n long")
    assert {(r.rara, r.comun) for r in V.typo_links(df).collect()} == want


def test_columns_apart_and_unified(spark):
    df = spark.createDataFrame([("M", "M")] * 5 + [("Masculino", "mes"), (None, "Martes")], "sexo string, otro string")
    got = sorted(map(tuple, V.unified(df, ["sexo", "otro"]).distinct().collect()), key=str)
    assert got == sorted([("Masculino", "M"), ("Masculino", "Mes"), (None, "Martes")], key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
