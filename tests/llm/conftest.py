from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that an operator might use for itself.
        *(T.StructField(name, T.StringType()) for name in ("h", "ord", "words", "fp", "shard", "spots", "component_id")),
    ]
)


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with further columns whose names clash."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(__import__("pathlib").Path(__file__).parents[2]))
    return lambda rows: spark.createDataFrame([(*row, "x")[:3] + ("own",) * 7 for row in rows], DOCS)
