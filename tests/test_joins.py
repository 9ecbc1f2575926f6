from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bidframe.operators.joins import join_by_share, small


@pytest.mark.parametrize("often", [1, 3, 100_000])
def test_frequent_and_rare_keys_join_alike(spark, often):
    rows = spark.range(300).select(F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("key"), "id")
    keyed = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = join_by_share(rows, keyed, ["key"], "n", rows.count(), often)
    assert got.columns == ["key", "id", "n"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed, "key").collect()))
    assert join_by_share(rows.where("id < 0"), keyed.where("n < 0"), ["key"], "n", 0, often).count() == 0


def test_small_tables_are_broadcast_and_larger_ones_merged(spark):
    rows = spark.range(50)
    plan = lambda side: rows.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small(spark.range(5), most=5)) and "SortMergeJoin" in plan(small(spark.range(6), most=5))


def test_dealt_tables_stay_in_bounded_tasks_and_meet_without_a_shuffle(spark):
    from bidframe.operators.joins import dealt

    a, b = spark.range(3000).withColumn("x", F.col("id") % 7), spark.range(0, 6000, 2)
    assert dealt(a, "id", 3000, 100).rdd.getNumPartitions() == 30
    met = dealt(a, "id", 3000, 100).join(dealt(b, "id", 3000, 100).hint("merge"), "id", "left_anti")
    sizes = met.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in sizes) == 1500 and len(sizes) == 30 and max(r["count"] for r in sizes) < 100
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_merged_outcomes_are_sorted_in_bounded_tasks(spark):
    from bidframe.operators import ledger

    deals = spark.createDataFrame([(i, True, "synthetic") for i in range(40)], "rfp_id long, won boolean, source string")
    said = spark.createDataFrame([(1, "lost", 1), (1, "won", 2), (2, "won", 1), (2, "cancelled", 2), (3, "lost", 1), (99, "won", 1)], "rfp_id long, result string, recorded_at int")
    merged = ledger.merge_outcomes(deals, said)
    rows = {r.rfp_id: (r.won, r.source) for r in merged.collect()}
    assert len(rows) == 40 and 2 not in rows and rows[1] == rows[99] == (True, "outcome") and rows[3] == (False, "outcome") and rows[0] == (True, "synthetic")
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("REPARTITION_BY_NUM") >= 2
