from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows in two partitions."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(2)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a long text, repeated rows."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    return make_docs([(1, None), (2, ""), (3, " \n\t\n"), (4, long_text), (5, "A b"), (5, "A b"), (None, "A b c"), (None, None)])
