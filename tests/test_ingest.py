from datetime import date

from pyspark.sql import functions as F

from cohorte.operators.quality import dedupe_last, fk_orphans, pk_duplicates
from cohorte.operators.upsert import upsert
from cohorte.plans.ingest import ingest

P_COLS = "id_paciente string, sexo string, edad string, zona_residencia string, fecha_dx string, tipo_cancer string, estadio string, aseguradora string, adherencia_12m string, _fila long"
C_COLS = "id_consulta string, fecha_consulta string, motivo string, prioridad string, especialista string, id_paciente string, _fila long"
L_COLS = "id_lab string, fecha_muestra string, tipo_prueba string, resultado string, resultado_numerico string, unidad string, id_paciente string, _fila long"


def _batch(spark, p, c, l):
    return {
        "paciente": spark.createDataFrame(p, P_COLS),
        "consulta": spark.createDataFrame(c, C_COLS),
        "laboratorio": spark.createDataFrame(l, L_COLS),
    }


def test_ingest_quarantine_and_stats(spark):
    p = [
        ("P1", "F", "40", None, "2020-01-05", "Mama", "I", "X", "si", 1),
        ("P2", "M", "abc", "Rural", "2020-01-05", "Mama", "I", "X", "no", 2),      # bad int
        ("P3", "M", "50.9", "Rural", "31/12/2019", "Colon", "II", None, "1", 3),   # missing insurer
        ("P4", "M", "50.9", "Rural", "not-a-date", "Colon", "II", "Y", "1", 4),    # bad date
        ("P1", "F", "41", None, "2020-01-05", "Mama", "I", "X", "true", 5),        # repeated key, later wins
    ]
    c = [("C1", "01/02/2020", "Control", "Alta", "E1", "P1", 1), ("C2", "2020-02-01", "Control", "Alta", "E1", "P9", 2)]
    l = [("L1", "2020-02-01", "PSA", None, "1.5", None, "P1", 1), ("L2", "2020-02-01", "PSA", None, "nan", None, "P1", 2)]
    res = ingest(_batch(spark, p, c, l))
    pac = {r["id_paciente"]: r for r in res.tables["paciente"].collect()}
    assert set(pac) == {"P1"}
    assert pac["P1"]["edad"] == 41 and pac["P1"]["adherencia_12m"] is True
    errs = {r["clave"]: r["mensaje"] for r in res.errors.collect()}
    assert errs["P2"].startswith("Error en paciente P2: edad: valor no válido 'abc'")
    assert "aseguradora: valor requerido ausente" in errs["P3"]
    assert "fecha_dx: valor no válido" in errs["P4"]
    assert errs["C2"] == "Error en consulta C2: id_paciente: paciente inexistente (P9)"
    stats = {r["tabla"]: (r["insertados"], r["actualizados"], r["errores"]) for r in res.stats.collect()}
    assert stats == {"paciente": (1, 0, 3), "consulta": (1, 0, 1), "laboratorio": (2, 0, 0)}
    labs = {r["id_lab"]: r["resultado_numerico"] for r in res.tables["laboratorio"].collect()}
    assert labs == {"L1": 1.5, "L2": None}  # NaN text -> NULL (N1)


def test_upsert_twice_equals_once(spark):
    p = [("P1", "F", "40", None, "2020-01-05", "Mama", "I", "X", "si", 1)]
    c = [("C1", "2020-02-01", "Control", "Alta", "E1", "P1", 1)]
    batch = _batch(spark, p, c, [])
    once = ingest(batch)
    twice = ingest(batch, base=once.tables)
    for t in ("paciente", "consulta"):
        assert sorted(map(tuple, once.tables[t].collect())) == sorted(map(tuple, twice.tables[t].collect()))
    stats = {r["tabla"]: (r["insertados"], r["actualizados"]) for r in twice.stats.collect()}
    assert stats["paciente"] == (0, 1) and stats["consulta"] == (0, 1)


def test_update_replaces_all_columns(spark):
    base = spark.createDataFrame([("K1", "a", 1), ("K2", "b", 2)], "k string, v string, n int")
    inc = spark.createDataFrame([("K2", "z", 20), ("K3", "c", 3)], "k string, v string, n int")
    got = sorted(map(tuple, upsert(base, inc, "k").collect()))
    assert got == [("K1", "a", 1), ("K2", "z", 20), ("K3", "c", 3)]


def test_dedupe_last_and_checks(spark):
    df = spark.createDataFrame([("K1", "old", 1), ("K1", "new", 7), ("K2", "x", 3)], "k string, v string, o long")
    assert sorted(map(tuple, dedupe_last(df, "k", "o").collect())) == [("K1", "new", 7), ("K2", "x", 3)]
    assert [tuple(r) for r in pk_duplicates(df, "k").collect()] == [("K1", 2)]
    parent = spark.createDataFrame([("K1",)], "k string")
    assert [r["k"] for r in fk_orphans(df, parent, "k").collect()] == ["K2"]


def test_missing_sheet_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        ingest({"paciente": spark.createDataFrame([], P_COLS)})


def test_typed_sheet_dates_and_compat(spark):
    from datetime import date, datetime

    from cohorte.operators.quality import parse_sheet
    from cohorte.schemas import TABLES

    raw = spark.createDataFrame(
        [("C1", datetime(2020, 2, 1, 10, 30, 15, 123456), None, "Alta", "E1", "P1")],
        "id_consulta string, fecha_consulta timestamp, motivo string, prioridad string, especialista string, id_paciente string",
    )
    r = parse_sheet(raw, TABLES["consulta"]).first()
    assert r["fecha_consulta"] == date(2020, 2, 1) and r["_motivos"] == ["motivo: valor requerido ausente"]
    r2 = parse_sheet(raw, TABLES["consulta"], compat=True).first()
    assert r2["motivo"] == "nan"  # the text of a missing cell, as it is stored in this mode
    assert r2["_motivos"] == []  # so the row is stored, not quarantined


def test_compat_normalises_ids(spark):
    from cohorte.plans.cleaning import clean_table

    df = spark.createDataFrame([(" p1 ", "f", 30, None, date(2020, 1, 1), "mama", "i", "x", True)],
                               "id_paciente string, sexo string, edad int, zona_residencia string, fecha_dx date, "
                               "tipo_cancer string, estadio string, aseguradora string, adherencia_12m boolean")
    assert clean_table(df, "paciente").cleaned().first()["id_paciente"] == " p1 "
    assert clean_table(df, "paciente", compat=True).cleaned().first()["id_paciente"] == "P1"


def test_upsert_broadcasts_small_batch_keys(spark):
    from cohorte.operators.upsert import upsert_stats

    base = spark.range(5000).selectExpr("concat('K', id) AS k", "id AS v")
    batch = spark.createDataFrame([("K1", 10), ("K9999", 11)], "k string, v long")
    plan = upsert(base, batch, "k", n_keys=2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert "SortMergeJoin" not in plan
    got = sorted(map(tuple, upsert(base, batch, "k", n_keys=2).where("k in ('K1', 'K2', 'K9999')").collect()))
    assert got == [("K1", 10), ("K2", 2), ("K9999", 11)]
    st = upsert_stats(base, batch, "k", n_keys=2).first()
    assert (st["insertados"], st["actualizados"]) == (1, 1)
    st2 = upsert_stats(base, batch, "k").first()  # no bound known: planner's choice, same numbers
    assert (st2["insertados"], st2["actualizados"]) == (1, 1)
