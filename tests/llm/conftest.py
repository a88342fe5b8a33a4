from __future__ import annotations

import pytest

pytest.importorskip("tessella.llm")

SCHEMA = "doc_id long, text string, source string, _next string, n long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns whose names the operators also use."""
    long = " ".join(f"word{i % 977}." for i in range(20_000))
    rows = [
        (1, "One fine day the fox met the hound in the wood.\nOne fine day the fox met the hound in the wood.", "src1", "x", 1),
        (1, "One fine day the fox met the hound in the wood.\nOne fine day the fox met the hound in the wood.", "src1", "x", 1),
        (1, "Another text of the same id, which is long enough to be kept by the rules.", None, None, None),
        (2, None, None, None, None),
        (None, "A text without an id, which is long enough to be kept by the rules here.", "src2", None, 5),
        (3, "", "", "", 0),
        (4, " \n\t \n", "src", "y", 2),
        (5, long, "src", "y", 3),
        (6, "日本語のテキスト 🙂 <|endoftext|> done", "src", "y", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
