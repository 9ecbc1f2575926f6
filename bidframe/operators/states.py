"""Aggregates kept as tables of states: made once a batch, merged by addition, finished on demand.

A state of calibration is a row for each group and bin with a count and two
sums. States of any batches add up, so a report over a longer time or a
coarser group reads states and never the predictions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "sum_p", "sum_y"]


def calibration_states(pred: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``keys, bin, n, sum_p, sum_y`` of predictions ``(keys, p, y)``; bins are (lo, hi].

    Predictions of 0 lie in no bin. Rows whose ``p`` or ``y`` is null have no
    outcome to compare and count nowhere. Null keys are a group. No rows give none.
    """
    rows = pred.where("p > 0 AND y IS NOT NULL")
    return rows.groupBy(*keys, F.ceil(F.round(F.col("p") * bins, 9)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col("y").cast("double")).alias("sum_y"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the coarser ``keys``: a sum for each group and bin."""
    return states.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in SUMS))


def finish_calibration(states: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, ece, max_gap``: the expected and the largest calibration error of each group's merged states."""
    gap = F.abs(F.col("sum_p") - F.col("sum_y")) / F.col("n")
    return merge_states(states, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))) / F.sum("n")).alias("ece"), F.max(gap).alias("max_gap"))
