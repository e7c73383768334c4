from datetime import date

import pytest
from pyspark.sql import functions as F

from cohorte.plans import queries as Q
from cohorte.plans import summaries as R
from cohorte.plans.ingest import deliver
from cohorte.sources import store as S
from cohorte.sources.tables import read_all
from cohorte.streaming.uploads import landing_schema

AS_OF = date(2021, 1, 1)


def sheets(spark, p=(), c=(), lab=()):
    rows = {
        "paciente": [(k, "F", "40", None, "2020-01-05", t, "I", "X", "si", i) for i, (k, t) in enumerate(p)],
        "consulta": [(k, d, "Control", "Alta", "E1", who, i) for i, (k, d, who) in enumerate(c)],
        "laboratorio": [(k, d, test, None, v, None, who, i) for i, (k, d, test, v, who) in enumerate(lab)],
    }
    return {n: spark.createDataFrame(r, landing_schema(n)) for n, r in rows.items()}


def norm(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()) if "dias_sin_consulta" not in df.columns else sorted(map(str, df.collect()))


def same_as_from_scratch(spark, root):
    t = read_all(spark, root)
    resumen, dias = R.read_summaries(spark, root)
    assert norm(Q.features_of(t["paciente"], R.rollup_of(resumen), AS_OF)) == norm(Q.feature_table(t["paciente"], t["consulta"], t["laboratorio"], AS_OF))
    assert norm(Q.dashboard_of(t["paciente"], R.rollup_of(resumen, dias, AS_OF, 6))) == norm(Q.dashboard_by_type(t["paciente"], t["consulta"], t["laboratorio"], AS_OF, 6))
    visits = resumen.select("id_paciente", "ultima_consulta", F.col("count_consultas").alias("total_consultas"))
    assert norm(Q.inactive_of(t["paciente"], visits, AS_OF)) == norm(Q.inactive_patients(t["paciente"], t["consulta"], AS_OF))
    whole = R.grouped_days(R.day_rows("consulta", t["consulta"]).unionByName(R.day_rows("laboratorio", t["laboratorio"])))
    assert sorted(map(str, dias.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    return {r["id_paciente"]: r for r in resumen.collect()}


def test_deliveries_step_by_step(spark, scratch):
    d1 = sheets(
        spark,
        p=[("P1", "Mama"), ("P2", "Colon"), ("P3", "Mama")],
        c=[("C1", "2020-02-01", "P1"), ("C2", "2020-09-01", "P1"), ("C3", "2020-08-01", "P2")],
        lab=[("L1", "2020-02-01", "PSA", "0.1", "P1"), ("L2", "2020-02-01", "PSA", "0.2", "P1"), ("L3", "2020-03-01", "Biopsia PSA", "nan", "P2")],
    )
    deliver(spark, scratch, d1, n_cells=4, summaries=True)
    got = same_as_from_scratch(spark, scratch)
    assert (got["P1"].primera_consulta, got["P1"].count_laboratorios) == (date(2020, 2, 1), 2)
    # a visit moves to another day, one to another patient, a result changes, one lab is new
    d2 = sheets(spark, c=[("C1", "2020-12-01", "P1"), ("C3", "2020-08-01", "P3")], lab=[("L1", "2020-02-01", "PSA", "0.4", "P1"), ("L4", "2020-01-02", "VPH", "1e35", "P3")])
    deliver(spark, scratch, {n: d2[n] for n in ("consulta", "laboratorio")}, n_cells=4)
    got = same_as_from_scratch(spark, scratch)
    assert (got["P1"].primera_consulta, got["P1"].ultima_consulta) == (date(2020, 9, 1), date(2020, 12, 1))
    assert got["P2"].count_consultas == 0 and got["P2"].primera_consulta is None and got["P3"].count_consultas == 1
    # P3 loses all it has: its days are gone, in whatever cell they lie
    d3 = sheets(spark, c=[("C3", "2020-08-01", "P1")], lab=[("L4", "2020-01-02", "VPH", "5", "P1")])
    deliver(spark, scratch, {n: d3[n] for n in ("consulta", "laboratorio")}, n_cells=4)
    got = same_as_from_scratch(spark, scratch)
    assert "P3" not in got and got["P1"].grande_avg_vph == 0.0
    # a replayed batch changes nothing
    for _ in range(2):
        deliver(spark, scratch, {"consulta": sheets(spark, c=[("C9", "2020-05-05", "P2")])["consulta"]}, stream=("s", 4), n_cells=4)
    assert same_as_from_scratch(spark, scratch)["P2"].count_consultas == 1


def test_summaries_can_begin_later(spark, scratch):
    d1 = sheets(spark, p=[("P1", "Mama")], c=[("C1", "2020-02-01", "P1")], lab=[("L1", "2020-02-01", "PSA", "1", "P1")])
    deliver(spark, scratch, d1, n_cells=4)
    with pytest.raises(FileNotFoundError):
        R.read_summaries(spark, scratch)
    deliver(spark, scratch, {"consulta": sheets(spark, c=[("C2", "2020-03-01", "P1")])["consulta"]}, n_cells=4, summaries=True)
    assert same_as_from_scratch(spark, scratch)["P1"].count_consultas == 2


def test_only_named_patients_cells_are_written(spark, scratch):
    n = 400
    d1 = sheets(spark, p=[(f"P{i}", "Mama") for i in range(n)], c=[(f"C{i}", "2020-02-01", f"P{i}") for i in range(n)])
    deliver(spark, scratch, d1, n_cells=32, summaries=True)
    before = S.latest(spark, scratch).tables
    deliver(spark, scratch, {"consulta": sheets(spark, c=[("C1", "2020-02-02", "P1"), ("N1", "2020-02-03", "P7")])["consulta"]}, n_cells=32)
    after = S.latest(spark, scratch).tables
    for name in (R.DAYS, R.PATIENTS, "consulta"):
        assert 0 < sum(after[name].cells[c] != before[name].cells.get(c) for c in after[name].cells) <= 2
    assert after["paciente"] == before["paciente"]
    same_as_from_scratch(spark, scratch)
