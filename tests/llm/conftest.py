import pytest

#: Columns of documents with extra ones that operators use as names of their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, n int, cls int, key string, h long, kept string"


def rows_of(texts):
    return [(i, t, "en", "web", len(t or ""), "x", "y", 1, 2, "z", 3, "w") for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    """Documents (id, text) as a table with clashing extra columns."""
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


#: Nulls, blanks, ties, repeated rows, and a text longer than any chunk.
EDGES = [(1, None), (2, ""), (3, "   "), (4, "One two three"), (5, "one TWO three"), (6, "É one"), (7, "é one"), (8, "a"), (9, "a"), (9, "a"), (10, "word " * 200_000), (11, "Word " * 200_000), (None, "a"), (None, None)]


@pytest.fixture(scope="session")
def edges():
    return EDGES
