import pytest
from pyspark.sql import Row

#: Rows that every operator must take: nulls in any column, empty and long texts, ties, repeated rows.
HARD = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \n\t ", "en", "b", 5),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "x" * 50_000, "de", "a", 50_000),
    (7, "Über größe.\nUnd mehr é 😀 <|endoftext|>\x01\x00 4111 1111 1111 1111", "de", "a", 20),
    (7, "Über größe.\nUnd mehr é 😀 <|endoftext|>\x01\x00 4111 1111 1111 1111", "de", "a", 20),
    (None, "a null id, mail me@example.com or +1 (555) 123-4567", "en", None, 3),
    (8, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same rows with extra columns that operators use inside."""
    extra = ["size", "bucket", "hash", "d", "l", "k", "n", "fp", "score", "base", "taken", "idx", "target", "items", "spans"]
    return hard.selectExpr("*", *[f"'{x}' AS {x}" for x in extra])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [Row(**r.asDict()) for r in documents.collect()]
