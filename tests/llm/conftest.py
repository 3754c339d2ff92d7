import os
import sys

import duckdb
import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))

from llm_paths import SF_SMALL  # noqa: E402

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (doc_id, text[, lang]) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            text = r[1]
            full.append((r[0], text, r[2] if len(r) > 2 else "en", "s", None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def duck():
    if not os.path.exists(f"{SF_SMALL}/documents.parquet"):
        pytest.skip("driver test data not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con
