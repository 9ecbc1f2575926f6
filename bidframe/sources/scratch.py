"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-scratch-")


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that setting is absent, a local folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or _local_folder()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, true sizes, columns and filters that reach the scan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/bidframe-{uuid.uuid4().hex}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
