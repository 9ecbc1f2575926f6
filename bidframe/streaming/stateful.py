"""Stateful streams on keyed state with event-time timers.

State shrinks: a price that is no longer fresh is forgotten, a buffered row
leaves when the watermark passes it, a throttle's failures expire. Rows that
arrive out of order inside the watermark are put in order first, so what a
stream says does not depend on how its input was cut into batches. The state
store must be RocksDB (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The setting that keyed state and timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


class FreshestPrice(StatefulProcessor):
    """The freshest price of each competitor for a product (ST3): a row when a fresher one arrives, and one without a price when it is ``max_age_ms`` old.

    A product's competitors share one value and one timer, at the first of
    them to be forgotten. Products are many with few rows each, so it takes
    and gives rows: each call to the state and each data frame costs more than
    the work on a row.
    """

    def __init__(self, max_age_ms: int) -> None:
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "competitors array<bigint>, ats array<bigint>, prices array<double>")

    def _held(self) -> dict[Any, tuple[int, float]]:
        held = self.best.get()
        return {c: (at, price) for c, at, price in zip(*held)} if held else {}

    def _forget_at(self, held: dict[Any, tuple[int, float]]) -> int | None:
        return min(at for at, _ in held.values()) // 1000 + self.max_age_ms if held else None

    def _keep(self, held: dict[Any, tuple[int, float]]) -> None:
        self.best.update((list(held), [at for at, _ in held.values()], [price for _, price in held.values()]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new: dict[Any, tuple[int, float]] = {}
        for r in rows:
            new[r.competitor_id] = max((r.at, r.unit_price), new.get(r.competitor_id, (r.at, r.unit_price)))
        held = self._held()
        fresher = {c: best for c, best in new.items() if c not in held or best[0] > held[c][0]}
        if fresher:
            before = self._forget_at(held)
            held.update(fresher)
            after = self._forget_at(held)
            if before != after:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(after)
            self._keep(held)
            for c, (at, price) in fresher.items():
                yield Row(mpn=key[0], competitor_id=c, at=at, unit_price=price)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        kept = {c: best for c, best in held.items() if best[0] // 1000 + self.max_age_ms > passed}
        if kept:
            self.handle.registerTimer(self._forget_at(kept))
            self._keep(kept)
        else:
            self.best.clear()
        for c, (at, _) in held.items():
            if c not in kept:
                yield Row(mpn=key[0], competitor_id=c, at=at, unit_price=None)

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time: each waits until the watermark passes it.

    One timer stands for a key, at the earliest row that waits. Subclasses
    give the columns of a waiting row besides ``at``, and say what a row means.
    """

    columns: tuple[tuple[str, str], ...]
    time = "ts"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, " + ", ".join(f"{n} {t}" for n, t in self.columns))
        self.next = handle.getValueState("next", "ms long")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Further state."""

    def each(self, key: Any, rows: list[tuple]) -> list[tuple]:
        """What the rows, in order, give."""
        raise NotImplementedError

    def made(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _wake(self, earliest: int) -> None:
        """Move the key's timer to the earliest waiting row."""
        held = self.next.get()[0] if self.next.exists() else None
        if held is None or earliest < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(earliest)
            self.next.update((earliest,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            new += zip(_micros(batch[self.time]).tolist(), batch["tie"].tolist(), *(batch[n].tolist() for n, _ in self.columns))
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in rows if r[0] // 1000 <= passed], [r for r in rows if r[0] // 1000 > passed]
        self.next.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0] // 1000)
        else:
            self.waiting.clear()
        out = self.each(key, due)
        if out:
            yield self.made(out)

    def close(self) -> None:
        pass


class PriceAlerts(InOrder):
    """A row for each move of a price by ``limit`` percent or more against the price before it (ST4)."""

    columns, time = (("unit_price", "double"),), "effective_from"

    def __init__(self, limit: float) -> None:
        self.limit = limit

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.previous = handle.getValueState("previous", "price double")

    def each(self, key: Any, rows: list[tuple]) -> list[tuple]:
        last, out = self.previous.get()[0] if self.previous.exists() else None, []
        for at, _, price in rows:
            if last and abs(price / last - 1) * 100 >= self.limit:
                out.append((key[0], pd.Timestamp(at, unit="us"), last, price))
            last = price
        if rows:
            self.previous.update((last,))
        return out

    def made(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["sku", "effective_from", "previous", "unit_price"])


class Throttle(InOrder):
    """The failures at which a key is blocked (ST2): the ``limit``-th within ``seconds``; a success clears, and at most ``limit`` times are held."""

    columns = (("kind", "string"),)

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getListState("failures", "at long")

    def each(self, key: Any, rows: list[tuple]) -> list[tuple]:
        recent, out = [r[0] for r in self.failures.get()] if self.failures.exists() else [], []
        for at, tie, kind in rows:
            recent = [] if kind == "success" else [t for t in recent if at - t <= self.seconds * 1_000_000][1 - self.limit:] + [at]
            if kind != "success" and len(recent) >= self.limit:
                out.append((key[0], tie, pd.Timestamp(at, unit="us")))
        if recent:
            self.failures.put([(t,) for t in recent])
        else:
            self.failures.clear()
        return out

    def made(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "tie", "ts"])


class RetrainTrigger(StatefulProcessor):
    """A signal after each ``every`` labels of a model (ST5); state is one number for each model."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        now = before + sum(len(batch) for batch in rows)
        self.seen.update((now,))
        signals = [s * self.every for s in range(before // self.every + 1, now // self.every + 1)]
        if signals:
            yield pd.DataFrame({"model": [key[0]] * len(signals), "labels": signals})

    def close(self) -> None:
        pass


def freshest_price(obs: DataFrame, max_age: str = "180 days", late: str = "2 days") -> DataFrame:
    """``mpn, competitor_id, observed_on, unit_price``: update mode; a null price says that the key has no fresh price any more (ST3)."""
    rows = obs.select("mpn", "competitor_id", F.col("observed_on").cast("timestamp").alias("observed_on"), "unit_price").where("unit_price IS NOT NULL AND observed_on IS NOT NULL")
    rows = rows.withWatermark("observed_on", late).withColumn("at", F.unix_micros("observed_on")).withColumn("unit_price", F.col("unit_price").cast("double"))
    found = rows.groupBy("mpn").transformWithState(FreshestPrice(_milliseconds(max_age)), "mpn long, competitor_id long, at long, unit_price double", "Update", "EventTime")
    return found.select("mpn", "competitor_id", F.timestamp_micros("at").alias("observed_on"), "unit_price")


def price_alerts(versions: DataFrame, limit: float = 25.0, late: str = "2 days") -> DataFrame:
    """``sku, effective_from, previous, unit_price`` (ST4). Rows: sku, effective_from, unit_price, tie (orders equal times)."""
    rows = versions.where("unit_price IS NOT NULL AND effective_from IS NOT NULL").withWatermark("effective_from", late)
    return rows.groupBy("sku").transformWithStateInPandas(PriceAlerts(limit), "sku long, effective_from timestamp, previous double, unit_price double", "Append", "EventTime")


def throttle(events: DataFrame, limit: int = 8, seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """``key, tie, ts`` of the failures that block (ST2). Rows: key, ts, kind, tie (orders equal times)."""
    rows = events.where("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Throttle(limit, seconds), "key long, tie long, ts timestamp", "Append", "EventTime")


def retrain_trigger(labels: DataFrame, every: int = 5) -> DataFrame:
    """``model, labels`` (ST5). Rows: model and any others."""
    return labels.groupBy("model").transformWithStateInPandas(RetrainTrigger(every), "model string, labels long", "Append", "None")


def _milliseconds(span: str) -> int:
    number, unit = span.split()
    return int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
