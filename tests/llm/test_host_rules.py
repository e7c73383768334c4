import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from cohorte.llm import host_rules as H

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_marks"]


def brute_repeated(w):
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert H.repeated_words(words) == brute_repeated(words)


def test_measures():
    text = "one two\nthree\n\none two\n \n# a|b  é\none two"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert H.measures(text) == (len(words), sum(map(len, words)), 2, 5, 2, 0)
    assert H.measures(None) == H.measures("") == (0,) * 6
    assert H.measures("a b c d e " * 3)[5] == 15
    assert H.measures("x " * 200_000)[5] == 200_000


def doc(i, host, n=40, bad=False):
    words = [f"w{i}x{j}" for j in range(n)]
    if bad:
        words = [w + "#%&" for w in words]
    return Row(doc_id=i, text=" ".join(words), lang="en", source=host, n_chars=0, host="h", n="n", marks="m")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def oracle(spark, df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cur = con.execute(H.SQL)
    names = [d[0] for d in cur.description]
    return sorted(([dict(zip(names, r))[c] for c in COLUMNS] for r in cur.fetchall()), key=str)


def test_a_bad_host_loses_only_what_fails(spark):
    docs = [doc(i, "good") for i in range(300)] + [doc(300 + i, "good", bad=True) for i in range(6)]
    docs += [doc(400 + i, "bad", bad=i % 10 > 0) for i in range(60)]
    docs += [doc(500, "tiny", bad=True)]  # one document proves nothing
    docs += [doc(510 + i, f"h{i}") for i in range(20)]
    df = spark.createDataFrame(docs).repartition(5)
    got = rows_of(H.host_quality(df))
    assert all(got[i].kept for i in range(306))
    assert {i: got[i].kept for i in range(400, 460)} == {400 + i: i % 10 == 0 for i in range(60)}
    assert got[500].kept and got[500].host_marks == "" and got[400].host_marks == "symbols"
    assert sorted([list(r[c] for c in COLUMNS) for r in got.values()], key=str) == oracle(spark, df)


def test_rates_are_shrunk(spark):
    rng = random.Random(4)
    docs = [doc(i, f"h{i % 25}", bad=rng.random() < (i % 25) / 40) for i in range(1500)] + [doc(9000, "one", bad=True)]
    rates = {r.source: r for r in H.host_rates(H.measured(spark.createDataFrame(docs))).collect()}
    for r in rates.values():
        raw = r.fails_symbols / r.n
        mean = sum(x.fails_symbols for x in rates.values()) / 1501
        assert min(raw, mean) - 1e-9 <= r.rate_symbols <= max(raw, mean) + 1e-9
    one = rates["one"]
    assert one.fails_symbols == 1 and one.rate_symbols < 0.5


@pytest.mark.parametrize("hot", [20_000, 1])
def test_messy_rows(spark, messy, monkeypatch, hot):
    monkeypatch.setattr("cohorte.llm.skew.HOT_KEYS", hot)  # broadcast or shuffled hosts
    got = H.host_quality(messy)
    assert got.columns == COLUMNS
    rows = sorted([list(r) for r in got.collect()], key=str)
    assert len(rows) == messy.count()
    assert rows == oracle(spark, messy)


def test_empty(spark, no_docs):
    assert H.host_quality(no_docs).collect() == []
