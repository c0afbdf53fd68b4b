from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = "thon ere password=abc123def " * 4000
    rows = [(1, "Hello there, mail bob.x@mail.example.com now", "en", "a"), (2, None, "de", None), (3, "", None, "a"), (4, long, "en", "b"), (4, long, "en", "b"), (5, "12345 67", "fr", "a"), (None, "no id here at all", "en", "a"), (6, "Hello there, mail bob.x@mail.example.com now", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit(1), "band": F.lit("x"), "ids": F.lit(2), "taken": F.lit("t"), "row": F.lit(0), "id": F.lit(9), "score": F.lit(0)})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
