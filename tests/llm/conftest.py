import pytest


@pytest.fixture()
def frame(spark):
    """Rows to a DataFrame; an empty list gives an empty table."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(frame):
    """(doc_id, text) pairs as a documents table."""
    return lambda pairs: frame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCS)
