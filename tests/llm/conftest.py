import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, text_sha256 string, found string, file string, n long"


@pytest.fixture(scope="session")
def docs_from(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names the operators use inside."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), 1, "x", "y", "z", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def awkward(docs_from):
    """Null keys and texts, empty and white texts, repeated rows, a very long text."""
    return docs_from([
        (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None),
        (5, "word " * 60_000), (6, "mail a.b@c.org now"), (7, "é" * 300),
    ])
