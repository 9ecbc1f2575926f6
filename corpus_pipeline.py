"""Corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``. The caller writes each result and reads it back as the next
stage's ``docs``.

No stage is limited by the length of a text. Null ids and texts, empty texts,
repeated rows, empty tables and extra columns of any name pass as the
operators' docstrings say: rows are told apart by id and text, an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidframe.llm._common import written
from bidframe.llm.decontam import drop_leaks
from bidframe.llm.mixing import mix_sources
from bidframe.llm.sharding import shard_documents
from bidframe.llm.simhash import drop_near_copies
from bidframe.llm.toxicity import drop_toxic

#: The mixture takes four fifths of the tokens and no document twice.
BUDGET_SHARE, MAX_REPEATS = 0.8, 1.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows, does not reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The temperature mixture of the sources."""
    return mix_sources(docs, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The model, the components and the differencing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
