from datetime import date

import pytest

from cohorte.functions import dates as D
from cohorte.plans.ingest import INFER, deliver
from cohorte.sources.tables import read_latest
from cohorte.streaming.uploads import landing_schema


def read(spark, cells, **kw):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, d string")
    found = D.infer_formats(df, ["d"], **kw)
    return found["d"], [r["d"] for r in D.parsed_dates(df, found).orderBy("i").collect()]


@pytest.mark.parametrize(
    "cells, state, want",
    [
        (["03/04/2020", "04/30/2020"], "unico", [date(2020, 3, 4), date(2020, 4, 30)]),
        (["03/04/2020", "30/04/2020"], "unico", [date(2020, 4, 3), date(2020, 4, 30)]),
        (["03/04/2020", None, " "], "ambiguo", [date(2020, 4, 3), None, None]),
        (["05/05/2020"], "unico", [date(2020, 5, 5)]),
        (["03/04/2020", "30/04/2020", "04/30/2020", "06/06/2020"], "mezclado", [None, date(2020, 4, 30), date(2020, 4, 30), date(2020, 6, 6)]),
        (["2020-04-30", "20200501", "30.04.2020"], "varios", [date(2020, 4, 30), date(2020, 5, 1), date(2020, 4, 30)]),
        # the order shown by one separator holds for the writer's other cells
        (["13/04/2020", "01-02-2020"], "varios", [date(2020, 4, 13), date(2020, 2, 1)]),
        (["2020-02-30", "2020-02-28", "soon", "NaN"], "ilegible", [None, date(2020, 2, 28), None, None]),
        ([None, ""], "vacio", [None, None]),
        (["2020-04-30T10:00:00", "2020-04-30 23:59:59"], "varios", [date(2020, 4, 30)] * 2),
        (["05-Mar-2020"], "unico", [date(2020, 3, 5)]),
    ],
)
def test_verdicts(spark, cells, state, want):
    found, got = read(spark, cells)
    assert (found.state, got) == (state, want)


def test_preferred_order(spark):
    assert read(spark, ["03/04/2020"], month_first=True)[1] == [date(2020, 3, 4)]
    assert read(spark, ["03/04/2020", "30/04/2020"], month_first=True)[1][0] == date(2020, 4, 3)


def test_delivery_of_american_and_mixed_sheets(spark, scratch):
    p = [("P1", "F", "40", None, "12/31/2019", "Mama", "I", "X", "si", 1), ("P2", "F", "40", None, "01/02/2020", "Mama", "I", "X", "si", 2)]
    c = [("C1", "31/01/2020", "Control", "Alta", "E1", "P1", 1), ("C2", "01/31/2020", "Control", "Alta", "E1", "P1", 2), ("C3", "02/03/2020", "Control", "Alta", "E1", "P1", 3)]
    sheets = {"paciente": spark.createDataFrame(p, landing_schema("paciente")), "consulta": spark.createDataFrame(c, landing_schema("consulta"))}
    res = deliver(spark, scratch, sheets, formats=INFER, n_cells=2)
    assert {k: f.state for k, f in res.formats.items()} == {"paciente.fecha_dx": "unico", "consulta.fecha_consulta": "mezclado"}
    assert {r.id_paciente: r.fecha_dx for r in read_latest(spark, scratch, "paciente").collect()} == {"P1": date(2019, 12, 31), "P2": date(2020, 1, 2)}
    assert {r.id_consulta for r in read_latest(spark, scratch, "consulta").collect()} == {"C1", "C2"}
    assert [r.mensaje for r in res.errors().collect()] == ["Error en consulta C3: fecha_consulta: valor no válido '02/03/2020'"]
