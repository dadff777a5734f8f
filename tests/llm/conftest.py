"""Small frames with what the operators must withstand, shared by the tests of this folder."""

import pytest

#: doc_id, text, and columns whose names clash with working names of the operators.
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog. " * 12, "x", 1),
    (2, None, "x", 1),
    (3, "", None, None),
    (4, " \t\n ", "x", 1),
    (5, "the quick brown fox jumps over the lazy dog. " * 12, "x", 1),
    (5, "the quick brown fox jumps over the lazy dog. " * 12, "x", 1),
    (None, "no key here but a few words", "x", 1),
    (7, "É" * 40 + " " + "long " * 30_000, "x", 1),
    (8, "<|endoftext|> <s> ▁ \x00 tab\there", "x", 1),
]
ODD_SCHEMA = "doc_id long, text string, length string, part int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
