"""Near-duplicates against all pairs compared as word tuples."""

import numpy as np
import pytest

from cohorte.llm.components import components
from cohorte.llm.near_dups import PERCENT, deduplicated, near_duplicates, similar
from cohorte.llm.shingles import shingle_sets
from cohorte.llm.superminhash import band_keys, signatures


def word_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: word_sets(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_shingles_are_those_of_the_words():
    texts = [b"A b  c\td e f", b"a b c d e F", b"", None, b"one two", b"a b c d e", b"\x0b x\x0c", "é é é é é é".encode()]
    sets = list(shingle_sets(texts, 5))
    assert [len(s) for s in sets] == [len(word_sets((t or b"").decode())) for t in texts]
    assert (sets[0] == sets[1]).all() and sets[5][0] in sets[0]


def test_superminhash_estimates_similarity_and_places_are_filled():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = np.concatenate((common, own[:100])), np.concatenate((common, own[100:]))
    sig = signatures([a, b, a[:1], a[:7]], 144)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
    assert (sig < np.uint64(144 << 32)).all()
    assert sorted((sig[2] >> np.uint64(32)).tolist()) == list(range(144))  # one element fills every place, step by step
    assert (signatures([a], 144)[0] == sig[0]).all()
    assert band_keys(sig, 24, 6).shape == (4, 24)


def test_similar_at_the_boundary():
    x = np.arange(100, dtype=np.uint64)
    assert similar(x, x[:85]) and not similar(x, x[:84]) and not similar(x[:84], x)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(5, 40), (7, 7), (2, 3), (3, 2)] + [(100, i) for i in range(101, 140)]
    table = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(table, few=0).collect()}
    assert got == {r.node: r.component for r in components(table).collect()}
    assert {got[i] for i in range(11, 41)} == {5} and got[10] == 5 and got[3] == 2
    assert {got[i] for i in range(101, 140)} == {100} and not {2, 5, 7, 100} & set(got)


def test_messy_rows(messy, spark):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    expected = brute(rows)
    got = near_duplicates(messy).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)
    kept = deduplicated(messy)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 5, 7, 8, 9, 10, 11, 12, 13, None, None]


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_edited_copies_and_chains(spark, word_text):
    """A group of edited copies (pairs near the threshold), a chain, and copies of a few words."""
    base = word_text(9, 120).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for j in range(1 + i % 6):
            w[(i * 17 + j * 29) % len(w)] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    chain = word_text(10, 100).split()
    for i in range(30):  # neighbours are similar, the ends are not
        rows.append((200 + i, " ".join(chain[i * 3 :] + [f"c{k}" for k in range(i * 3)])))
    rows += [(300 + i, f"alpha beta gamma delta epsilon zeta eta theta iota kappa {i % 7}") for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_tables_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == expected
