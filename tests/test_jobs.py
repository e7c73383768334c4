import os

from cohorte.plans import jobs as J
from cohorte.sources.fixtures import raw_sheets
from cohorte.sources.logs import read_log
from cohorte.sources.tables import list_versions, read_latest

SF = "/root/testdata/sf0.001"


def test_end_to_end_jobs(spark, scratch):
    up = os.path.join(scratch, "upload")
    for name, df in raw_sheets(spark, SF).items():
        df.write.option("header", True).csv(os.path.join(up, name))
    store = os.path.join(scratch, "store")
    first = J.ingest_job(spark, up, store)
    again = J.ingest_job(spark, up, store)  # same upload twice: all updates, same table
    assert first["version"] == "00000000000000000001" and again["version"] == "00000000000000000002"
    assert again["estadisticas"]["paciente"]["insertados"] == 0
    assert again["estadisticas"]["paciente"]["actualizados"] == first["estadisticas"]["paciente"]["insertados"]
    n_pac = read_latest(spark, store, "paciente").count()
    cleaned = J.clean_job(spark, store)
    assert cleaned["version"] == "00000000000000000003"
    cl = read_latest(spark, store, "paciente")
    assert cl.count() == n_pac and cl.where("zona_residencia is null").count() == 0
    assert len(list_versions(spark, store, "laboratorio")) == 3
    feats = J.features_job(spark, store, os.path.join(scratch, "features"), as_of="2001-08-01")
    assert feats["total_registros"] == n_pac
    rep = J.report_job(spark, store, os.path.join(scratch, "reports"), as_of="2001-08-01")
    assert len(rep["reportes"]) == 3
    tr = J.train_job(spark, os.path.join(scratch, "features"), os.path.join(scratch, "models"), "neural_network")
    assert 0 <= tr["metricas_test"]["accuracy"] <= 1
    J.score_job(spark, os.path.join(scratch, "features"), os.path.join(scratch, "models"), "neural_network", os.path.join(scratch, "log"))
    assert read_log(spark, os.path.join(scratch, "log")).count() == n_pac
