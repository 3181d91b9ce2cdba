import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (key, text) pairs, with further columns whose names clash with those of results."""

    def make(rows, key="doc_id", text="text"):
        schema = f"{key} long, {text} string, n_tokens long, score string, spans string"
        return spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], schema)

    return make
