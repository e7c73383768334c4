import re

import pytest

from cohorte.llm.licences import CORES, PHRASES, licences, rules


def base(text):
    """The contract's base columns, word by word."""
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3 or any later version.", "gpl,gpl-3.0-or-later"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("// SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("see https://creativecommons.org/licenses/by-sa/3.0/ now", "cc-by-sa-3.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of", "mit"),
    ("apache\nLICENSE apache license xapache license", "apache"),
    ("a summit license of limits; a comma cc byte", ""),
    ("CC\t\tBY cc by ccby", "cc-by"),
    ("Mozilla Public License 2.0 and MIT License", "mit,mpl-2.0"),
]


def test_rules_are_many_and_valid_for_the_jvm():
    assert 300 <= len(rules()) and all(r.keywords and r.label for r in rules())


def test_rows(spark, messy):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(100, None, "x"), (101, "", "x"), (None, "MIT License", "x"), (102, "word " * 40_000 + "gnu general  public-license", "x"), (0, CASES[0][0], "x")]
    got = licences(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(got, rows, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        for d in r.detections:
            assert 0 <= d.start < d.end <= len(text)
    for r, (_, want) in zip(got, CASES, strict=False):
        assert r.labels == want
    assert licences(messy).count() == messy.count()
    assert licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licences(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])


UNGATED = [
    ("released under GPLv3", "gpl-3.0"),
    ("GNU GPLv2", "gpl-2.0"),
    ("LGPLv2.1 or later", "lgpl-2.1-or-later"),
    ("MPL 2.0", "mpl-2.0"),
    ("EPL-2.0", "epl-2.0"),
    ("0BSD", "0bsd"),
    ("CDDL 1.1, EUPL 1.2, LPPL 1.3, ODbL 1.0", "cddl-1.1,eupl-1.2,lppl-1.3,odbl-1.0"),
    ("GFDL1.3 and ASL 2.0 and CeCILL", "apache-2.0,cecill,gfdl-1.3"),
    ("all rights\n * reserved", "proprietary"),
    ("unless required by applicable law or agreed\n  to\n  in writing", "apache-2.0"),
    ("neither\n   the name of the owner may be used to endorse or promote products", "bsd-3-clause"),
    ("dedicated to the public\ndomain", "public-domain"),
    ("the examples comply with simple replacement of gnus", ""),
]


def test_the_rules_alone_decide(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(UNGATED)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences(rows).collect()}
    for i, (text, want) in enumerate(UNGATED):
        assert set(want.split(",")) <= set(got[i].labels.split(",")) and bool(want) == bool(got[i].labels), (text, got[i].labels)


def test_cores_follow_from_the_rules():
    for r in rules():
        assert r.core in r.regex and set(r.keywords) <= set(CORES[r.core])
