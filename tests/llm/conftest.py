import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) with extra columns that clash with names the operators use."""

    def make(rows):
        schema = "doc_id long, text string, key string, n int, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, t, "k", 1, "en", "s", len(t or "")) for i, t in rows], schema)

    return make
