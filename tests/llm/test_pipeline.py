"""The pipeline against its stages done by brute force on the smallest tables."""

import duckdb

import corpus_pipeline
from cohorte.llm import mixing
from cohorte.llm.common import table
from cohorte.llm.personal_data import redact
from cohorte.llm.toxicity import toxicity
from tests.llm.test_near_dups import brute

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity(docs, table(spark, SF, "labels")).collect() if r.predicted}
    clean = [(i, r.text) for i, r in rows.items() if i not in toxic]
    kept = [i for i, (_, component) in brute(clean).items() if i == component]
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = [i for i in kept if not any(b in rows[i].text for b in bench)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, redact(rows[i].text), rows[i].source) for i in kept])
    want = {r[0]: r for r in con.execute(mixing.SQL).fetchall()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r["size"], r.source_size, r.target, r.taken, r.position) == want[r.doc_id]
        assert r.text == redact(rows[r.doc_id].text) and r.n_chars == len(r.text) and r.lang == rows[r.doc_id].lang


def test_stages_keep_the_columns(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == messy.columns, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
