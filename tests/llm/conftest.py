import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, h1 string, rep int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, an empty, a blank and a long text, repeated rows, and columns named like the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", None, 0.5, 1, "x", 7) for i, t, lang in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, long, "en"), (5, "one two", "de"), (5, "one two", "de"), (None, "no id here at all", "en"), (6, "12345 !!! 678", "en")]
    rows.append((7, "xy" * 300, "en"))  # one unbroken run
    return documents(rows)


@pytest.fixture(scope="session")
def none(documents):
    return documents([]).limit(0)


@pytest.fixture(scope="session")
def vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("links", T.StringType()), T.StructField("norm", T.StringType())])

    def make(rows):
        return spark.createDataFrame([(i, x, "a", "b") for i, x in rows], schema)

    return make
