import pytest
from pyspark.sql import types as T

LONG = "word one two three. " * 20_000


@pytest.fixture(scope="session")
def docs_schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark, docs_schema):
    """Nulls, empty and long texts, ties, repeated rows and clashing names (added by each test)."""
    rows = [
        (1, "a b\tc", "en", "s"), (2, "abc ", "en", "s"), (3, " a  bc", None, "s"), (4, None, "en", None), (5, "", "en", "s"), (6, " \n", "en", "s"),
        (7, LONG, "en", "s"), (7, LONG, "en", "s"), (None, "abc", "en", "s"), (9, "été 😀 x́", "fr", "s"), (10, "ABC", "en", "s"), (11, "<|endoftext|> it's 12 \x1c\x85y　z", "de", "s"),
    ]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture(scope="session")
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
