"""Batch jobs: the reference's HTTP endpoints re-aimed as Spark jobs.

Every job reads and writes the versioned table store (see
:mod:`cohorte.sources.store`): all tables of a job appear in one commit, so jobs
can run on different clusters, and a failed job leaves the previous version of
all tables in place.

    python -m cohorte.plans.jobs ingest   --sheets DIR --store ROOT
    python -m cohorte.plans.jobs clean    --store ROOT
    python -m cohorte.plans.jobs features --store ROOT --out DIR [--as-of YYYY-MM-DD]
    python -m cohorte.plans.jobs train    --features DIR --models ROOT --kind xgboost
    python -m cohorte.plans.jobs score    --features DIR --models ROOT --kind xgboost --log DIR
    python -m cohorte.plans.jobs report   --store ROOT --out DIR [--as-of YYYY-MM-DD]
    python -m cohorte.plans.jobs vacuum   --store ROOT [--keep 2] [--min-age-hours 24]
"""

from __future__ import annotations

import argparse
import json
import os
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohorte.functions.parse import DEFAULT_DATE_FORMATS
from cohorte.plans import queries as Q
from cohorte.plans.cleaning import clean_all, combined_report, summary
from cohorte.plans.ingest import INFER, ORDER, deliver
from cohorte.plans.scoring import score_requests
from cohorte.plans.summaries import PATIENTS, rebuilt
from cohorte.plans.training import train
from cohorte.schemas import FEATURES
from cohorte.sources.logs import append_log
from cohorte.plans.kpis import served_versions
from cohorte.sources.registry import load_version, new_version, read_registry, save_model
from cohorte.sources import store as keyed
from cohorte.sources.tables import latest_feature_csv, load_sheets, read_all, version_id, write_feature_csv
from cohorte.schemas import TABLES


def ingest_job(spark: SparkSession, sheets: str, store: str, fmt: str = "csv", n_cells: int = keyed.DEFAULT_CELLS, summaries: bool | None = None, infer_dates: bool = False) -> dict:
    """Upload endpoint -> one new version of the three tables, with the
    batch's statistics and quarantined rows."""
    res = deliver(spark, store, load_sheets(spark, sheets, fmt), n_cells=n_cells, summaries=summaries, formats=INFER if infer_dates else DEFAULT_DATE_FORMATS)
    stats = {t: {"tabla": t} | s for t, s in res.stats.items()}
    return {"version": res.version, "estadisticas": stats, "errores": res.errors_path, "formatos": {c: f.state for c, f in res.formats.items()}}


def clean_job(spark: SparkSession, store: str) -> dict:
    """Cleaning endpoint -> cleaned tables as one new version + reports."""
    runs = {}

    def work(at: keyed.Snapshot) -> keyed.Work:
        tables = {n: keyed.read(spark, store, n, at, schema=TABLES[n].schema) for n in ORDER}
        if any(t is None for t in tables.values()):
            raise FileNotFoundError(f"no hay tablas en {store}")
        runs.clear()
        runs.update(clean_all(tables))
        changes = [keyed.replace(run.cleaned().select(*TABLES[n].columns), store, n, (TABLES[n].key,), at.tables[n].n_cells) for n, run in runs.items()]
        if PATIENTS in at.tables:
            cleaned = {c.name: keyed.read(spark, store, c.name, keyed.Snapshot(0, {c.name: c.table})) for c in changes}
            changes += rebuilt(spark, store, cleaned, at.tables[PATIENTS].n_cells)
        return keyed.Work(changes, {n: None for n in ORDER})

    at, _ = keyed.transact(spark, store, work)
    version = version_id(at.version)
    rep_dir = os.path.join(store, "_reportes", f"version={version}")
    combined_report(runs).write.mode("overwrite").parquet(os.path.join(rep_dir, "combinado"))
    summary(runs).write.mode("overwrite").parquet(os.path.join(rep_dir, "resumen"))
    return {"version": version, "reportes": rep_dir}


def _current(spark: SparkSession, store: str) -> dict | None:
    return read_all(spark, store)


def features_job(spark: SparkSession, store: str, out: str, as_of: str | None = None) -> dict:
    """Dataset endpoint -> timestamped CSV feature dataset."""
    t = _current(spark, store)
    if t is None:
        raise FileNotFoundError(f"no hay tablas en {store}")
    f = Q.feature_table(t["paciente"], t["consulta"], t["laboratorio"], as_of=as_of)
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    return write_feature_csv(f, out, stamp)


def train_job(spark: SparkSession, features_dir: str, models: str, kind: str) -> dict:
    """Training endpoint -> model artefact + registry row."""
    res = train(latest_feature_csv(spark, features_dir, FEATURES), kind)
    version = new_version()
    path = save_model(spark, models, res.model, res.record(version))
    return {"version": version, "path": path, "metricas_test": res.metrics_test, "segundos": res.train_seconds}


def load_served(spark: SparkSession, models: str, kind: str) -> tuple:
    """The model that X18 says is to be served: not always the newest."""
    row = served_versions(read_registry(spark, models).where(F.col("model_type") == kind)).where("ultima").first()
    if row is None:
        raise FileNotFoundError(f"No hay modelos entrenados de tipo {kind}")
    return load_version(spark, models, kind, row["version_servida"])


def score_job(spark: SparkSession, features_dir: str, models: str, kind: str, log: str) -> dict:
    """Prediction endpoint re-aimed as batch scoring into the log (M11, M12), with the version that is served."""
    model, entry = load_served(spark, models, kind)
    reqs = latest_feature_csv(spark, features_dir, FEATURES).withColumn("tipo_modelo", F.lit(kind))
    append_log(score_requests(model, reqs, entry["version"]), log)
    return {"version": entry["version"], "log": log}


def report_job(spark: SparkSession, store: str, out: str, as_of: str | None = None) -> dict:
    """Analysis endpoints (Q1-Q3) written as Parquet reports."""
    t = _current(spark, store)
    if t is None:
        raise FileNotFoundError(f"no hay tablas en {store}")
    reports = {
        "brecha_laboratorio_diagnostico": Q.lab_dx_gap(t["paciente"], t["laboratorio"]),
        "pacientes_inactivos": Q.inactive_patients(t["paciente"], t["consulta"], as_of=as_of),
        "dashboard_tipo_cancer": Q.dashboard_by_type(t["paciente"], t["consulta"], t["laboratorio"], as_of=as_of),
    }
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(os.path.join(out, name))
    return {"reportes": sorted(reports)}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cohorte.plans.jobs")
    ap.add_argument("job", choices=["ingest", "clean", "features", "train", "score", "report", "vacuum"])
    for opt in ("--sheets", "--store", "--out", "--features", "--models", "--log", "--as-of"):
        ap.add_argument(opt)
    ap.add_argument("--kind", default="xgboost")
    ap.add_argument("--infer-dates", action="store_true")
    ap.add_argument("--summaries", action="store_true", help="keep patient summaries up from now on")
    ap.add_argument("--keep", type=int, default=2)
    ap.add_argument("--min-age-hours", type=float, default=24.0)
    ap.add_argument("--format", default="csv")
    a = ap.parse_args(argv)
    from cohorte.session import get_session

    spark = get_session()
    if a.job == "ingest":
        out = ingest_job(spark, a.sheets, a.store, a.format, summaries=a.summaries or None, infer_dates=a.infer_dates)
    elif a.job == "clean":
        out = clean_job(spark, a.store)
    elif a.job == "features":
        out = features_job(spark, a.store, a.out, a.as_of)
    elif a.job == "train":
        out = train_job(spark, a.features, a.models, a.kind)
    elif a.job == "score":
        out = score_job(spark, a.features, a.models, a.kind, a.log)
    elif a.job == "vacuum":
        out = keyed.vacuum(spark, a.store, a.keep, a.min_age_hours)
    else:
        out = report_job(spark, a.store, a.out, a.as_of)
    print(json.dumps(out, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
