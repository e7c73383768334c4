"""Registered queries against their DuckDB oracle on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from cohorte.plans.registry import load_all
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = [
    "q1_lab_dx_gap", "q2_inactive_patients", "q3_dashboard_by_type", "q4_feature_table",
    "c3_normalisation_report", "c7_missing_report", "c10_outlier_report", "q5_clean_laboratorio",
    "q6_ingest_stats", "i6_quarantine", "m2_encoded_features", "m3_split", "a16_a17_baseline_metrics",
    "x11_time_to_treatment", "x17_feature_drift", "x19_harmonisation_map", "x19_harmonised_patients",
    "x11_visits_with_last_lab", "x18_served_versions", "x19_variant_map", "i1_inferred_formats", "i1_inferred_dates", "t3_windows_and_late", "t3_sessions",
    "x20_stream_quality", "x20_rule_quality", "s5_feature_csv", "s7_log_tail", "t3_stream_windows",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "adherencia_12m" in df.columns


def test_every_query_has_sql_or_is_model_based():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    no_sql = set(load_all()) - set(s)
    assert all(n.startswith(("m5", "m6", "m7", "m11", "s7", "t2", "t3", "x15", "x20")) for n in no_sql), no_sql


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]
