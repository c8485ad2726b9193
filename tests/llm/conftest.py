import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 5, "x"), (2, "", "en", None, 0, None), (3, "one two", None, "a", None, "x"), (4, "One TWO", "de", "b", 3, "x"), (4, "One TWO", "de", "b", 3, "x"),
        (None, "one two", "en", "a", 7, "x"), (5, long, "en", "a", 9, "x"), (6, long + " tail", "en", None, 9, "x"), (7, " \t\n\x0b ", "fr", "b", 2, "x"), (8, "123 456 !!", "fr", "c", 2, "x"), (9, "a\n\nb\r\na ", "es", "c", 2, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
