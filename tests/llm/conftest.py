import pytest

from querygrade.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang) rows."""
    return lambda rows: spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls, empty and blank texts, one very long text, ties, repeated rows."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    return documents([(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (5, words), (6, words), (None, "no id here at all, none"), (7, "é漢 😀 ok. fine"), (8, None, None)])
