from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bidframe.operators import ledger, pricing, states
from bidframe.operators.policy import SEGMENTS
from bidframe.sources import tabular


def _deals(spark, n=400):
    r = random.Random(7)
    rows = []
    for i in range(n):
        ratio = 0.7 + r.random() * 0.6
        rows.append((i, r.choice(SEGMENTS), ratio, r.randint(-24, 24), r.randint(-20, 20), r.random() < 0.3, r.random() < 0.3, r.random() < 1.4 - ratio, "outcome" if i % 5 == 0 else "synthetic"))
    return pricing.bid_features(spark.createDataFrame(rows, "deal_id int, segment string, price_ratio double, warranty_delta_months int, lead_time_delta_days int, bundled_value_add boolean, repeat_customer boolean, won boolean, source string"))


def _observed(deals):
    weight = F.when(F.col("source") == "outcome", 10.0).otherwise(1.0)
    won = deals.where("won").select(weight.alias("w"), *ledger.FEATURES).toPandas()
    return {"intercept": won.w.sum()} | {f: (won.w * won[f]).sum() for f in ledger.FEATURES}


def test_moments_of_a_fitted_model_are_the_observed_ones(spark):
    deals = _deals(spark)
    observed = _observed(deals)
    fitted = {r.feature: r.fitted for r in ledger.win_model_moments(deals, ledger.fit_win_model(deals)).collect()}
    assert fitted.keys() == observed.keys()
    for f in observed:
        assert fitted[f] == pytest.approx(observed[f], abs=1e-3), f


def test_moments_show_a_model_that_was_not_fitted_to_the_deals(spark):
    deals = _deals(spark)
    other = ledger.fit_win_model(deals.withColumn("won", ~F.col("won")))
    fitted = {r.feature: r.fitted for r in ledger.win_model_moments(deals, other).collect()}
    assert abs(fitted["intercept"] - _observed(deals)["intercept"]) > 1


def test_label_moments_add_up_to_the_rows(spark):
    rows = spark.createDataFrame([(f"{'red apple' if i % 3 else 'blue plum'} number {i % 4}", float(i % 3 > 0)) for i in range(60)], "text string, label double")
    model = ledger.fit_text_classifier(rows)
    got = {r.label: r.expected for r in ledger.label_moments(ledger.predict_distribution(model, rows)).collect()}
    assert got[0.0] == pytest.approx(20, abs=0.05) and got[1.0] == pytest.approx(40, abs=0.05)


def test_states_of_parts_merge_to_the_state_of_the_whole(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i % 4, r.choice([0.0, 0.1, 0.25, 0.3, 0.7, 1.0]), r.choice([0, 1, None])) for i in range(300)]
    pred = spark.createDataFrame(rows, "g string, part int, p double, y int")
    whole = {x.g: x for x in states.finish_calibration(states.calibration_states(pred, ["g"]), ["g"]).collect()}
    path = str(tmp_path / "states")
    for part in [0, 1, 2, 3, 1]:  # part 1 is written again
        tabular.append_batch(states.calibration_states(pred.where(F.col("part") == part), ["g"]), path, part)
    merged = {x.g: x for x in states.finish_calibration(spark.read.parquet(path), ["g"]).collect()}
    assert merged.keys() == whole.keys() == {"a", "b", None}
    for g in whole:
        assert merged[g].n == whole[g].n == sum(1 for a, _, p, y in rows if a == g and p > 0 and y is not None)
        assert merged[g].ece == pytest.approx(whole[g].ece) and merged[g].max_gap == pytest.approx(whole[g].max_gap)
    every = states.finish_calibration(spark.read.parquet(path), []).first()
    direct = ledger.calibration_error(pred.where("y IS NOT NULL")).first()
    assert every.ece == pytest.approx(direct.ece)


def test_states_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, p double, y int")
    assert states.finish_calibration(states.calibration_states(none, ["g"]), ["g"]).count() == 0


def test_load_if_empty_writes_once(spark, tmp_path):
    rows = spark.range(3)
    path = str(tmp_path / "loaded")
    assert tabular.load_if_empty(rows.where("id < 0"), "loaded_once", path)
    assert tabular.load_if_empty(rows, "loaded_once", path)
    assert not tabular.load_if_empty(spark.range(9), "loaded_once", path)
    assert spark.table("loaded_once").count() == 3
    spark.sql("DROP TABLE loaded_once")


def test_win_model_queries_join_the_deals_once_and_round_half_way_sums_up(spark):
    from bidframe.plans import model_queries, queries

    rows = queries.fit_rows(spark, "/root/testdata/sf0.001")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.feature: r.fitted for r in model_queries.q_win_moments(spark, "/root/testdata/sf0.01").collect()}
    assert got["gap_education"] == 1794.0  # its exact sum is 1793.95


def test_label_moments_are_exact_though_the_coefficients_end_before_their_optimum(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(" ".join(f"w{int(r.random() ** 3 * 400)}" for _ in range(r.randint(0, 60))), float(r.random() ** 2 * 3 // 1)) for _ in range(300)], "text string, label double")
    found = ledger.label_moments(ledger.predict_distribution(ledger.fit_text_classifier(rows), rows))
    got = {x.label: x.expected for x in found.collect()}
    counts = {x.label: x["count"] for x in rows.groupBy("label").count().collect()}
    assert len(counts) == 3 and got == {k: pytest.approx(n, abs=1e-4) for k, n in counts.items()}
