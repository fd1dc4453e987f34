import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, row_key string"


def doc(i, text, lang="en", source="s0", shard="x", key="y"):
    return (i, text, lang, source, None if text is None else len(text), shard, key)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and
    ids, columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 3000}" for i in range(30_000))
    rows = [doc(1, "one two three four"), doc(2, None), doc(3, ""), doc(4, " \t\n "), doc(None, "no id here at all"),
            (None, None, None, None, None, None, None), doc(5, long), doc(6, long), doc(7, "same row"),
            doc(7, "same row"), doc(8, "é" * 50 + " 10.0.0.1 a@b.co"), doc(9, "single")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf001_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
