"""Property checks with generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from cohorte.functions.numeric import clip
from cohorte.functions.text import normalise_text

# letters whose case mapping is the same in Java and Python (no ß, ligatures)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZáéíóúüñÁÉÍÓÚÜÑ0123456789-/. \t\n "


def python_rule(v):
    if v is None or v == "":
        return None
    return v.strip().capitalize()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=12)), min_size=1, max_size=40))
def test_normalise_matches_python_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(normalise_text("x")).collect()]
    assert got == [python_rule(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False, width=32)), min_size=1, max_size=30),
    st.floats(-100, 100, width=32),
    st.floats(0, 100, width=32),
)
def test_clip_stays_in_bounds(spark, values, lo, span):
    hi = lo + span
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(clip("x", lo, hi)).collect()]
    for v, g in zip(values, got):
        assert (g is None) == (v is None)
        if g is not None:
            assert lo <= g <= hi and (g == v or v < lo or v > hi)
