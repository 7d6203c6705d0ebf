import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from odd_rows import ODD  # noqa: E402

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(n, T.StringType()) for n in ("row", "fp", "kept", "tokens", "text_sha256", "_id", "held_out", "domain", "root")],
])


@pytest.fixture(scope="session")
def table(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""
    def make(rows):
        rows = [(*r, *("en", "src1")[len(r) - 2:]) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *"abcdefghi") for r in rows], SCHEMA)

    return make


@pytest.fixture()
def odd(table):
    return table(ODD)
