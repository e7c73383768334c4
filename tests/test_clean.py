import numpy as np
from pyspark.sql import functions as F

from cohorte.operators.clean import AdaptiveImputer, IQRWinsoriser, TextNormaliser, column_modes, null_rates
from cohorte.plans.cleaning import clean_table


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_imputer_branches(spark):
    # 10 rows. a: 1 null (10%) -> median; t: 1 null -> mode (tie -> lowest);
    # hi: 3 nulls (30%) numeric -> 0.0; ht: 2 nulls (exactly 20%) text -> left NULL;
    # zona_residencia: 5 nulls (50%) but has a default -> 'Desconocida'
    rows = []
    for i in range(10):
        rows.append((
            None if i == 0 else float(i),
            None if i == 0 else ("b" if i % 2 else "a"),
            None if i < 3 else float(i),
            None if i < 2 else "x",
            None if i < 5 else "Urbana",
        ))
    df = _frame(spark, rows, "a double, t string, hi double, ht string, zona_residencia string")
    model = AdaptiveImputer().fit(df)
    fill = model.fill_values()
    assert fill["a"] == 5.0  # median of 1..9
    assert fill["t"] == "b"  # b: i = 1,3,5,7,9 (5 rows); a: 2,4,6,8 (4 rows)
    assert fill["hi"] == 0.0
    assert "ht" not in fill
    assert fill["zona_residencia"] == "Desconocida"
    out = model.transform(df)
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    assert nulls == {"a": 0, "t": 0, "hi": 0, "ht": 2, "zona_residencia": 0}
    rep = {r["campo"]: r for r in model.report(spark).collect()}
    assert rep["ht"]["recomendacion"].startswith("No imputado (categórico) - porcentaje alto (20.00%)")
    assert rep["hi"]["recomendacion"] == "Imputados con 0 (3 registros) - alta tasa de faltantes (30.0%)"
    assert rep["a"]["recomendacion"] == "Imputados con mediana (5.00) - 1 registros"
    assert rep["ht"]["valores_faltantes"] == 2 and rep["a"]["valores_faltantes"] == 0


def test_mode_ties_lowest(spark):
    df = _frame(spark, [("b",), ("a",), ("b",), ("a",), ("c",)], "t string")
    assert column_modes(df, ["t"]).first()["valor"] == "a"


def test_integer_median_rounds_half_even(spark):
    df = _frame(spark, [(None,), (20,), (21,)] + [(20,), (21,)] * 5, "edad int")
    model = AdaptiveImputer().fit(df)
    assert model.fill_values()["edad"] == 20.5
    assert model.transform(df).where("edad is null").count() == 0
    assert model.transform(df).schema["edad"].dataType.typeName() == "integer"
    assert sorted({r[0] for r in model.transform(df).collect()}) == [20, 21]


def test_winsoriser_matches_numpy(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0, -50.0, None]
    df = _frame(spark, [(v,) for v in vals], "x double")
    model = IQRWinsoriser().fit(df)
    b = model.get_bounds()["x"]
    arr = np.array([v for v in vals if v is not None])
    q1, q3 = np.percentile(arr, [25, 75])
    assert abs(b["q1"] - q1) < 1e-12 and abs(b["q3"] - q3) < 1e-12
    out = [r[0] for r in model.transform(df).collect()]
    assert out[-1] is None
    assert all(b["inferior"] <= v <= b["superior"] for v in out if v is not None)
    rep = model.report(df).first()
    assert rep["outliers_detectados"] == 2 and rep["total_registros"] == 7
    vals_rep = [r["valor"] for r in model.outlier_values(df).orderBy("orden").collect()]
    assert vals_rep == [-50.0, 100.0]


def test_winsoriser_skips_empty_and_bool(spark):
    df = _frame(spark, [(None, True), (None, False)], "x double, b boolean")
    assert IQRWinsoriser().fit(df).get_bounds() == {}


def test_normaliser_report(spark):
    df = _frame(spark, [(" m ",), ("M",), ("",), ("  ",), (None,)], "sexo string")
    n = TextNormaliser()
    rep = n.report(df).first()
    # changed rows: " m " and "" and "  " (not "M", not NULL)
    assert rep["registros_modificados"] == 3
    assert rep["valores_unicos_antes"] == 4 and rep["valores_unicos_despues"] == 2
    ex = {r["valor_original"]: r["valor_normalizado"] for r in n.examples(df).collect()}
    assert ex == {"": None, "  ": "", " m ": "M"}


def test_pipeline_bounds_after_imputation(spark):
    # half the values missing: after the 0.0 default, Q1 is 0
    rows = [(f"L{i}", "2024-01-01", "PSA", None, None if i % 2 else float(10 + i), None, "P1") for i in range(20)]
    df = spark.createDataFrame(rows, "id_lab string, fecha_muestra string, tipo_prueba string, resultado string, "
                                     "resultado_numerico double, unidad string, id_paciente string").withColumn(
        "fecha_muestra", F.to_date("fecha_muestra"))
    run = clean_table(df, "laboratorio")
    b = run.winsoriser.get_bounds()["resultado_numerico"]
    assert b["q1"] == 0.0
    assert run.cleaned().where("resultado_numerico is null").count() == 0


def test_null_rates_counts_nan(spark):
    df = _frame(spark, [(float("nan"),), (None,), (1.0,), (2.0,)], "x double")
    r = null_rates(df).first()
    assert r["valores_nulos"] == 2 and r["porcentaje"] == 50.0


def test_reference_shaped_reports(spark):
    from cohorte.operators.clean import examples_map, outlier_lists

    df = _frame(spark, [("b ",), ("a ",), ("A",), ("c ",)], "t string")
    m = examples_map(TextNormaliser().examples(df, k=2)).first()
    assert m["ejemplos_cambios"] == {"a ": "A", "b ": "B"}
    vals = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0, -50.0, 200.0]
    xdf = _frame(spark, [(v,) for v in vals], "x double")
    model = IQRWinsoriser().fit(xdf)
    assert outlier_lists(model.outlier_values(xdf)).first()["valores_outliers"] == [-50.0, 100.0, 200.0]


def test_fits_together_equal_fits_one_after_the_other(spark):
    import random

    from cohorte.operators.clean import AdaptiveImputer, IQRWinsoriser, fit_together

    for seed in range(4):
        rng = random.Random(seed)
        miss = lambda share, v: None if rng.random() < share else v
        rows = [
            (
                f"k{i}", miss(0.1, rng.choice("abc")), miss(0.4, rng.choice("xy")), miss(0.15, rng.randrange(9)), miss(0.1, rng.gauss(0, 5)),
                miss(0.5, rng.choice([float("nan"), 1.5, -2.0, 7.0])), rng.random(), None, miss(0.3, rng.gauss(3, 1)),
            )
            for i in range(rng.choice([1, 7, 150]))
        ]
        df = spark.createDataFrame(rows, "id string, t string, u string, n int, a double, b double, c double, d double, resultado_numerico double").repartition(4)
        imputer, winsoriser = AdaptiveImputer(exclude=["id"]), IQRWinsoriser(exclude=["id"])
        fills = imputer.fit(df)
        bounds = winsoriser.fit(fills.transform(df))
        got_fills, got_bounds = fit_together(df, imputer, winsoriser)
        assert got_fills.fill_values() == fills.fill_values()
        for p in ("strategies", "stats", "total"):
            assert got_fills.getOrDefault(p) == fills.getOrDefault(p)
        assert got_bounds.get_bounds() == bounds.get_bounds()
    empty = df.limit(0)
    assert fit_together(empty, imputer, winsoriser)[1].get_bounds() == {}
