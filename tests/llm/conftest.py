from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and further columns whose names the operators use inside."""
    long = " ".join(f"word{k} and" for k in range(9000)) + ". " + "abc def ghi jkl mno pqr, " * 60
    rows = [(1, "Short text here."), (2, None), (3, ""), (None, "No id in this row, but some words, and more of them."), (4, long), (4, long),
            (5, "   \n\t "), (6, "Short text here."), (7, "ünïcödé \u0000 zero and \U0001f600 more"), (None, None), (8, "a" * 5000), (7, "another text under one id")]
    return spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in rows], "doc_id long, text string, lang string, did int, th int, row string")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
