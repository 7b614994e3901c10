import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("Text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType())])
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30000))


def docs_of(spark, rows):
    """documents with columns whose names clash with results or differ from inputs in case only."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "other", "s", "f") for i, t, s in rows], DOCS)


ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs on.", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs on.", "a"),  # a repeated row
    (2, None, None),
    (None, "A text without an id, password = abcdefghijkl1234", "b"),
    (None, None, "b"),
    (3, "", "a"),
    (4, " \t\n ", "c"),
    (5, LONG, "a"),
    (6, "one", "b"),
    (7, "naïve Ünïcode 漢字 \U0001f600 \x00 end", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, [])
