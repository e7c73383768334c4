from datetime import date

from cohorte.functions.numeric import clip, round_to
from cohorte.functions.parse import parse_bool, parse_date, parse_double, parse_int
from cohorte.functions.text import harmonise_key, normalise_text


def _one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_normalise_text_rules(spark):
    # N4 / C1: "" -> NULL, whitespace-only -> "", strip + capitalize, accents kept
    vals = [None, "", "   ", " pulmón ", "PULMÓN", "ii", "urbana rural", " mama\t"]
    got = [r[0] for r in _one_col(spark, vals).select(normalise_text("x")).collect()]
    assert got == [None, None, "", "Pulmón", "Pulmón", "Ii", "Urbana rural", "Mama"]


def test_normalise_is_idempotent(spark):
    vals = [" m ", "URBANA ", "iv", "Ii", "contributivo"]
    df = _one_col(spark, vals).select(normalise_text("x").alias("x"))
    once = [r[0] for r in df.collect()]
    twice = [r[0] for r in df.select(normalise_text("x")).collect()]
    assert once == twice


def test_parse_bool(spark):
    # A text cell has to be one of the words, untrimmed; NULL -> False
    vals = ["true", "1", "yes", "si", "sí", "SI", " si", "no", None, "2", "0", "nan", "x", " 1 ", "1d"]
    got = [r[0] for r in _one_col(spark, vals).select(parse_bool("x")).collect()]
    assert got == [True] * 6 + [False] * 9
    numbers = spark.createDataFrame([(1.0,), (2.0,), (0.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(parse_bool("x", numeric=True)).collect()] == [True, True, False, False, False]


def test_parse_date_formats(spark):
    vals = ["2024-03-05", "05/03/2024", "2024-03-05 10:11:12", "2024/03/05", "not a date", None]
    got = [r[0] for r in _one_col(spark, vals).select(parse_date("x")).collect()]
    d = date(2024, 3, 5)
    assert got == [d, d, d, d, None, None]


def test_parse_numbers(spark):
    got = [tuple(r) for r in _one_col(spark, ["3.7", "abc", "nan", "12", None]).select(parse_int("x"), parse_double("x")).collect()]
    assert got == [(3, 3.7), (None, None), (None, None), (12, 12.0), (None, None)]


def test_round_scales_first(spark):
    # Spark's round(1.005, 2) is 1.01 (decimal text); scaling first gives
    # 1.0, as SQL engines do (2.675 * 100 is exactly 267.5, so 2.68)
    import duckdb

    vals = [1.005, 2.675, 50.125, -1.5, 0.285]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_to("x", 2)).collect()]
    expected = [duckdb.sql(f"select round({v}::double, 2)").fetchall()[0][0] for v in vals]
    assert got == expected
    assert got[0] == 1.0


def test_clip_keeps_null(spark):
    # greatest/least would turn NULL into a bound; clip must not
    df = spark.createDataFrame([(None,), (0.0,), (1.7,), (9.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 1.5, 2.5)).collect()]
    assert got == [None, 1.5, 1.7, 2.5]


def test_harmonise_key(spark):
    got = [r[0] for r in _one_col(spark, ["Pulmón", " pulmon ", "PULMÓN"]).select(harmonise_key("x")).collect()]
    assert got == ["pulmon"] * 3
