"""Stateful streams with timers, restarted between parts; batches that are written twice."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bidframe.operators import corpus
from bidframe.sources import tabular
from bidframe.streaming import queries as streams
from bidframe.streaming import stateful
from bidframe.streaming.replay import replay

T0 = dt.datetime(2026, 1, 1)


def h(n):
    return T0 + dt.timedelta(hours=n)


def test_throttle_orders_late_rows_and_forgets(spark):
    schema = "key long, ts timestamp, kind string, tie long"
    first = [(1, h(2), "failure", 3), (1, h(1), "failure", 2), (2, h(0), "failure", 1)]
    # a success that comes late but in time, two failures, one that is too late, and one that the watermark never passes
    then = [(1, h(1.5), "success", 9), (1, h(3), "failure", 4), (1, h(3.1), "failure", 5), (1, h(-40), "failure", 7), (1, h(30), "failure", 6)]
    got = replay([spark.createDataFrame(p, schema) for p in (first, then)], lambda x: stateful.throttle(x, 2, 7_200, "2 hours"), partitions=2)
    assert sorted((r.key, r.tie) for r in got.collect()) == [(1, 4), (1, 5)]


def test_freshest_price_expires(spark):
    schema = "mpn long, competitor_id long, observed_on timestamp, unit_price double"
    first, then = [(1, 1, h(0), 5.0), (1, 2, h(240), 6.0)], [(1, 1, h(216), 7.0), (1, 1, h(200), 1.0), (1, 3, h(4_800), 9.0), (1, 3, h(4_799), 8.0)]
    got = replay([spark.createDataFrame(p, schema) for p in (first, then)], lambda x: stateful.freshest_price(x, "180 days", "2 days"), "update", 2)
    last = {(r.competitor_id): r.p for r in got.groupBy("competitor_id").agg(F.max_by("unit_price", F.struct("observed_on", "batch")).alias("p")).collect()}
    assert last == {1: None, 2: None, 3: 9.0}


def test_freshest_prices_of_a_product_share_one_state(spark):
    """Competitors of one product come and are forgotten at their own times, over restarts."""
    schema = "mpn long, competitor_id long, observed_on timestamp, unit_price double"
    parts = [[(1, c, h(24 * c), float(c)) for c in range(6)] + [(2, 1, h(0), 4.0)], [(1, 0, h(240), 9.0), (1, 4, h(24), 3.0)], [(1, 7, h(24 * 14), 7.0)], [(3, 1, h(24 * 14), 1.0)]]
    found = replay([spark.createDataFrame(p, schema) for p in parts], lambda x: stateful.freshest_price(x, "10 days", "12 hours"), "update", 2)
    rows = sorted(((r.mpn, r.competitor_id, r.batch, r.unit_price) for r in found.collect()), key=str)
    last = {(m, c): p for m, c, _, p in sorted(rows, key=lambda r: r[2])}
    assert last == {(1, 0): 9.0, (1, 1): None, (1, 2): None, (1, 3): None, (1, 4): 4.0, (1, 5): 5.0, (1, 7): 7.0, (2, 1): None, (3, 1): 1.0}
    assert sum(p is None for *_, p in rows) == 4 and len(rows) == 14
    state = stateful.FreshestPrice(1000)
    assert state._forget_at({1: (5_000, 1.0), None: (3_000, 2.0)}) == 1003


def test_alerts_do_not_depend_on_the_cut(spark):
    rows = [(1, h(k), p, k) for k, p in enumerate((100.0, 130.0, 131.0, 90.0, 90.0, 10.0))] + [(2, h(1), 5.0, 9), (2, h(900), 1.0, 10)]
    schema = "sku long, effective_from timestamp, unit_price double, tie long"
    said = []
    for parts in ([rows], [rows[1::2], rows[::2]]):
        got = replay([spark.createDataFrame(p, schema) for p in parts], lambda x: stateful.price_alerts(x, 25.0, "5000 hours"), partitions=2)
        done = replay([spark.createDataFrame(p, schema) for p in [*parts, [(3, h(20_000), 1.0, 1)]]], lambda x: stateful.price_alerts(x, 25.0, "5000 hours"), partitions=2)
        assert got.count() == 0
        said.append(sorted((r.sku, r.previous, r.unit_price) for r in done.collect()))
    assert said[0] == said[1] == [(1, 90.0, 10.0), (1, 100.0, 130.0), (1, 131.0, 90.0), (2, 5.0, 1.0)]


def test_retrain_trigger_counts_over_restarts(spark):
    parts = [spark.createDataFrame([("m", k) for k in range(n)] + [("q", 1)], "model string, id int") for n in (4, 7, 1)]
    got = replay(parts, lambda x: stateful.retrain_trigger(x, 5), partitions=2)
    assert sorted((r.model, r.labels) for r in got.collect()) == [("m", 5), ("m", 10)]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "versions")
    rows = lambda *xs: spark.createDataFrame([(x, h(800 * x)) for x in xs], "sku long, effective_from timestamp")
    tabular.write_price_versions(rows(1, 2, 3), path, 0)
    tabular.write_price_versions(rows(7), path, 1)
    tabular.write_price_versions(rows(1, 2), path, 0)
    tabular.write_price_versions(rows(7), path, 1)
    assert sorted(r.sku for r in spark.read.parquet(path).collect()) == [1, 2, 7]


def test_feed_takes_the_rate_of_the_day_and_rescues_damage(spark, tmp_path):
    offers = [{"mpn": "m", "currency": "USD", "unit_price": 8.0, "observed_at": f"2026-01-0{k}T10:00:00"} for k in (1, 2, 3, 4)] + [{"mpn": "other", "currency": "USD", "unit_price": 8.0, "observed_at": "2026-01-02T00:00:00"}]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, offers), '{"mpn": "m", "unit_pr', '{"mpn": "m", "unit_price": "dear"}']))
    feed = tabular.read_feed(spark, str(tmp_path))
    assert [r.rescued[:12] for r in feed.where("rescued IS NOT NULL").collect()] == ['{"mpn": "m",'] * 2
    rates = spark.createDataFrame([("USD", dt.date(2026, 1, 2), 2.0), ("USD", dt.date(2026, 1, 4), 4.0)], "currency string, valid_from date, rate double")
    days = streams.daily_rates(rates, "2026-01-05")
    assert days.count() == 4
    got = streams.feed_join(feed.where("rescued IS NULL"), spark.createDataFrame([("m", "Mouse")], "mpn string, name string"), days)
    assert sorted((r.day.day, r.price_base) for r in got.collect()) == [(2, 4.0), (3, 4.0), (4, 2.0)]


@pytest.mark.parametrize("digits", [1, 3])
def test_content_digest_does_not_depend_on_order_or_company(spark, digits):
    rows = [(k % 3 if k % 7 else None, f"text {k % 290}") for k in range(900)] + [(9, None), (9, "")]
    a = spark.createDataFrame(rows, "k long, text string")
    of = lambda df: {r.k: r.digest for r in corpus.content_digest(df, ["k"], digits=digits).collect()}
    whole = of(a)
    assert of(spark.createDataFrame(rows[::-1], "k long, text string")) == whole and len(set(whole.values())) == 5
    assert of(a.where("k = 1"))[1] == whole[1] and of(a.where("k = 1 AND text <> 'text 1'"))[1] != whole[1]
