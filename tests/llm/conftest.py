import pytest


@pytest.fixture
def docs(spark):
    """``documents`` of (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(*pairs):
        rows = [(i, t, "en", "src0", len(t or ""), "own", 1.5, 7) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, score double, id int")

    return make


@pytest.fixture
def labels(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
