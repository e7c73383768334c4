import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use for their own columns
        T.StructField("score", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("band", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)


def sentence(seed: int, n: int) -> str:
    """``n`` words that are the same for the same seed only."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 100003}" for i in range(n))


MESSY = [
    (1, sentence(1, 60), "en", "a"),
    (2, sentence(1, 60), "en", "a"),  # exact copy
    (3, sentence(1, 60).upper(), "en", "b"),  # the same words, other case
    (4, sentence(1, 59) + " other", "en", "b"),  # near copy
    (4, sentence(1, 59) + " other", "en", "b"),  # repeated row
    (5, sentence(2, 3), "fr", None),  # fewer words than a shingle
    (6, sentence(2, 3), "fr", None),
    (7, "", "fr", "c"),
    (8, None, None, None),
    (9, " \n\t ", None, "c"),
    (10, sentence(3, 30000), "de", "a"),  # very long
    (11, "x" * 50_000, "de", "a"),  # one very long word
    (None, sentence(4, 40), "de", "a"),
    (None, None, None, None),
    (12, "Mail jane@example.com or +1 (755) 555-9729, card 4111 1111 1111 1111, host 10.0.0.1. MIT License.", "en", "d"),
    (13, "Reach john (at) example [dot] org é or five five five one two three four five six seven.", "en", "d"),
]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "s", "z", "k", "b", "w") for i, t, lang, s in MESSY]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def word_text():
    return sentence
