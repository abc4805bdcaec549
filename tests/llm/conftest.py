import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with nulls, empty and very long texts, repeated rows and extra columns of clashing names."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s0", None if t is None else len(t), 9.0, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string").repartition(3)

    return make
