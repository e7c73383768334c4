import duckdb

from cohorte.llm import mixing


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(mixing.SQL).fetchall()


def test_messy_rows_match_sql(messy):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    named = [r for r in rows if r[0] is not None]  # the order of rows without id is Spark's own
    got = mixing.mixture(messy.filter("doc_id IS NOT NULL")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(oracle(named), key=key)
    every = mixing.mixture(messy).collect()
    assert len(every) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in every)


def test_targets_are_met(spark, word_text):
    # one source holds most words, one is capped at three times its size
    rows = [(i, word_text(i, 5 + i % 20), "a" if i % 3 else ("b" if i % 30 else "c")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(oracle(rows), key=str)
    source = {i: s for i, _, s in rows}
    for s in "abc":
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 25
        assert own[0].target <= 3 * own[0].source_size
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1


def test_documents_keep_their_columns(messy, no_docs):
    out = mixing.mixed_documents(messy)
    assert out.count() == messy.count() and set(messy.columns) <= set(out.columns)
    assert dict(out.dtypes)["size"] == "bigint"  # the mix's own column replaces one of the same name
    assert mixing.mixture(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
