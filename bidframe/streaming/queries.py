"""Streams of bids, offers, prices, labels and attempts; each also runs over a batch DataFrame where state is not needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def intake_counts(events: DataFrame, time: str = "ts", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each window and type; rows later than the watermark are dropped (ST1)."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, every), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def freshest_price(obs: DataFrame) -> DataFrame:
    """The freshest observation of each (mpn, competitor); an older row that comes late never wins (ST3).

    Update mode: one row a key whenever a fresher observation arrives. The
    state is one date and price a key.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, price = state.get if state.exists else (None, None)
        before = at
        for rows in batches:
            best = rows.sort_values(["observed_on", "unit_price"]).iloc[-1]
            if at is None or best["observed_on"].value // 1000 > at:
                at, price = best["observed_on"].value // 1000, float(best["unit_price"])
        state.update((at, price))
        if at != before:
            yield pd.DataFrame({"mpn": [key[0]], "competitor_id": [key[1]], "observed_on": [pd.Timestamp(at, unit="us")], "unit_price": [price]})

    return obs.select("mpn", "competitor_id", F.col("observed_on").cast("timestamp").alias("observed_on"), "unit_price").groupBy("mpn", "competitor_id").applyInPandasWithState(
        step, "mpn long, competitor_id long, observed_on timestamp, unit_price double", "at long, price double", "update", GroupStateTimeout.NoTimeout)


def price_alerts(versions: DataFrame, limit: float = 25.0) -> DataFrame:
    """A row whenever a SKU's price moves by ``limit`` percent or more against its last one (ST4)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        out = []
        for rows in batches:
            for at, price in rows.sort_values("effective_from")[["effective_from", "unit_price"]].itertuples(index=False):
                if previous and abs(price / previous - 1) * 100 >= limit:
                    out.append((key[0], at, previous, price))
                previous = price
        state.update((previous,))
        yield pd.DataFrame(out, columns=["sku", "effective_from", "previous", "unit_price"])

    return versions.groupBy("sku").applyInPandasWithState(step, "sku long, effective_from timestamp, previous double, unit_price double", "price double", "append", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, limit: int = 8, seconds: int = 900) -> DataFrame:
    """Failures at which a key is blocked; a success clears, failures older than ``seconds`` expire (ST2). Rows: key, ts, kind.

    The state holds at most ``limit`` times a key.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out = []
        for rows in batches:
            for ts, kind in rows.sort_values("ts")[["ts", "kind"]].itertuples(index=False):
                now = ts.timestamp()
                recent = [] if kind == "success" else [t for t in recent if now - t <= seconds][1 - limit :] + [now]
                if kind != "success" and len(recent) >= limit:
                    out.append((key[0], ts))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["key", "ts"])

    return events.groupBy("key").applyInPandasWithState(step, "key long, ts timestamp", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def retrain_trigger(labels: DataFrame, every: int = 5) -> DataFrame:
    """A signal after each ``every`` new labels of a model (ST5)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        n = before + sum(len(rows) for rows in batches)
        state.update((n,))
        signals = range(before // every + 1, n // every + 1)
        yield pd.DataFrame({"model": [key[0]] * len(signals), "labels": [s * every for s in signals]})

    return labels.groupBy("model").applyInPandasWithState(step, "model string, labels long", "n long", "append", GroupStateTimeout.NoTimeout)


def turnaround(runs: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """First start to last finish in each session of a bid (ST6)."""
    rows = runs.withWatermark("started_at", late).groupBy(F.session_window("started_at", gap), "bid_id").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    return rows.select("bid_id", "started_at", "finished_at", (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("seconds"))


def expiry(plans: DataFrame, commits: DataFrame, ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each plan with its commit inside the time to live, null once it expired (ST7)."""
    p = plans.withWatermark("created_at", late)
    c = commits.select(F.col("plan_id").alias("_plan"), "committed_at").withWatermark("committed_at", late)
    return p.join(c, (F.col("plan_id") == F.col("_plan")) & (F.col("committed_at") >= F.col("created_at")) & (F.col("committed_at") < F.col("created_at") + F.expr(f"INTERVAL {ttl}")), "left_outer").drop("_plan")


def daily_rates(rates: DataFrame, until: str) -> DataFrame:
    """``currency, day, rate``: each rate (currency, valid_from, rate) on the days from its own to the next one's, the last ones to ``until``."""
    w = Window.partitionBy("currency").orderBy("valid_from")
    last = F.coalesce(F.date_sub(F.lead("valid_from").over(w), 1), F.greatest(F.to_date(F.lit(until)), "valid_from"))
    spans = rates.select("currency", "rate", F.col("valid_from"), last.alias("_last")).where("_last >= valid_from")
    return spans.select("currency", F.explode(F.sequence("valid_from", "_last")).alias("day"), "rate")


def feed_join(feed: DataFrame, catalogue: DataFrame, rates: DataFrame) -> DataFrame:
    """Live offers with their product and the price in base currency (ST8): two stream-static joins.

    ``rates`` has a row for each currency, or, with a column ``day``, for each
    currency and day; an offer then takes the rate of the day it was observed.
    """
    offers = feed.join(catalogue, "mpn")
    if "day" in rates.columns:
        priced = offers.withColumn("day", F.to_date("observed_at")).join(rates, ["currency", "day"])
    else:
        priced = offers.join(rates, "currency")
    return priced.withColumn("price_base", F.col("unit_price") / F.col("rate"))
