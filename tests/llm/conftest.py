import pytest

DOCS = "doc_id long, text string, n long, p string, keep_id string, blocks int"


@pytest.fixture
def docs(spark):
    """A maker of document tables with columns whose names the operators use themselves."""
    return lambda *rows: spark.createDataFrame([(i, t, 1, "p", "k", 2) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (4, "One"), (None, "One"), (7, "word " * 20_000), (8, "é ñ ① 漢字 \x00 \x85")]


@pytest.fixture
def odd():
    return ODD
