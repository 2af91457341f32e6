import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# before any session starts: Python workers inherit it
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that operators use themselves
        T.StructField("name", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("fp", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """A frame of (doc_id, text) with extra columns whose names clash."""

    def make(rows):
        return spark.createDataFrame([(i, t, "n", 7, None, None, "x", 1) for i, t in rows], DOCS).repartition(3)

    return make
