"""Small tables for the corpus operators' tests."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows):
    """``rows`` of (doc_id, text); the other columns follow."""
    return spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], SCHEMA)
