import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with extra columns whose names clash with those of results."""

    def make(texts, first_id=0):
        rows = [(first_id + i, t, "en", "s", len(t or ""), "x", 7) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int"
        return spark.createDataFrame(rows, schema)

    return make
