import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators use inside."""

    def make(rows):
        data = [(k, t, "x", k, 1, "n") for k, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, name string, key long, fp int, source string")

    return make
