from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, `size` double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names the operators use themselves."""
    long_text = "\n".join(" ".join(f"w{(i * 7 + j) % 997}" for j in range(40)) for i in range(600))
    texts = [
        (1, "alpha beta gamma delta epsilon", "en", "a"),
        (2, "alpha beta gamma delta epsilon", "en", "b"),
        (3, "", "en", "a"),
        (4, None, None, None),
        (5, long_text, "de", "a"),
        (6, long_text + " tail", "de", None),
        (None, "no id here at all", "fr", "c"),
        (None, None, None, None),
        (8, "one", "en", "c"),
        (8, "one", "en", "c"),
        (9, " \t\n ", "", ""),
        (10, "ünïcode 😀 text\r\nwith lines\n\nand é", "es", "é"),
    ]
    rows = [(i, t, la, so, None if t is None else len(t), "x", 1, 2.0) for i, t, la, so in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
