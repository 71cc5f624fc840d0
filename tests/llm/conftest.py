import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in ("words", "key", "k1", "score", "host", "kept")]])


def documents(spark, rows):
    """Rows of (id, text) or (id, text, source) as a table with clashing extra columns."""
    full = []
    for row in rows:
        name, text, source = (*row, "s")[:3]
        full.append((name, text, "en", source, None if text is None else len(text), *"abcdef"))
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{k} {k % 7}." for k in range(30_000))
PROSE = ("It was the best of times and the worst of times, said the old man to the sea, and none "
         "of the people who heard him that day had any idea of what he meant by it. ")

#: Nulls, empty and very long texts, repeated rows, texts of few words, odd characters.
ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, LONG, None), (5, "one", "b"),
       (6, PROSE * 3, "b"), (6, PROSE * 3, "b"), (None, PROSE + "x", "b"), (7, PROSE * 3, "c"),
       (8, "é \x00 \x1c日本 👍🏽 ΑΣ", "c"), (8, "other text of the same id", "c")]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
