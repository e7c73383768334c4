"""One patient holds a third of all child rows: results must equal the
naive per-row computation and the plan must stay a pre-aggregation."""

from datetime import date, timedelta

from pyspark.sql import types as T

from cohorte.plans import queries as Q
from cohorte.schemas import CONSULTA, LABORATORIO, PACIENTE


def loose(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def skewed(spark, n_patients=300):
    p = [(f"P{i}", "F", 20 + i % 50, None, date(2020, 1, 1), ["Mama", "Colon"][i % 2], "I", "X", i % 3 == 0) for i in range(n_patients)]
    visits, labs = [], []
    for i in range(n_patients):
        for j in range(2):
            visits.append((f"C{i}_{j}", date(2024, 1, 1) + timedelta(days=j * 90), "m", "p", "e", f"P{i}"))
            labs.append((f"L{i}_{j}", date(2021, 1, 1), ["PSA", "Biopsia"][j], None, float(i + j), None, f"P{i}"))
    hot = len(visits) // 2  # the hot patient ends with a third of all rows
    visits += [(f"CH{k}", date(2024, 6, 1), "m", "p", "e", "P0") for k in range(hot)]
    labs += [(f"LH{k}", date(2021, 2, 1), "PSA", None, float(k % 7), None, "P0") for k in range(hot)]
    return (
        spark.createDataFrame(p, loose(PACIENTE)),
        spark.createDataFrame(visits, loose(CONSULTA)),
        spark.createDataFrame(labs, loose(LABORATORIO)),
    )


def test_hot_patient_matches_naive(spark):
    p, c, l = skewed(spark)
    assert c.where("id_paciente = 'P0'").count() * 3 >= c.count() - 3
    feats = {r["id_paciente"]: r for r in Q.feature_table(p, c, l, as_of="2024-08-01").collect()}
    for name, df in (("paciente", p), ("consulta", c), ("laboratorio", l)):
        df.createOrReplaceTempView(f"s_{name}")
    naive = spark.sql("""
        SELECT p.id_paciente,
               (SELECT COUNT(*) FROM s_consulta c WHERE c.id_paciente = p.id_paciente) AS nc,
               (SELECT ROUND(COALESCE(AVG(l.resultado_numerico), 0) * 100) / 100 FROM s_laboratorio l WHERE l.id_paciente = p.id_paciente) AS avg_all
        FROM s_paciente p""").collect()
    for r in naive:
        f = feats[r["id_paciente"]]
        assert (f["count_consultas"], f["avg_resultado_numerico"]) == (r["nc"], r["avg_all"])
    dash = {r["tipo_cancer"]: r for r in Q.dashboard_by_type(p, c, l, as_of="2024-08-01").collect()}
    fan = spark.sql("""
        SELECT p.tipo_cancer, ROUND(AVG(p.edad) * 100) / 100 AS e, COUNT(DISTINCT l.id_lab) AS nl
        FROM s_paciente p LEFT JOIN s_consulta c ON p.id_paciente = c.id_paciente
        LEFT JOIN s_laboratorio l ON p.id_paciente = l.id_paciente GROUP BY p.tipo_cancer""").collect()
    for r in fan:
        assert (dash[r["tipo_cancer"]]["promedio_edad"], dash[r["tipo_cancer"]]["total_laboratorios"]) == (r["e"], r["nl"])


def test_feature_plan_has_no_fanout(spark):
    p, c, l = skewed(spark, 20)
    plan = Q.feature_table(p, c, l, as_of="2024-08-01", ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # children are combined map-side before the only child exchange
    assert "partial_count" in plan and plan.count("hashpartitioning(id_paciente") <= 2
