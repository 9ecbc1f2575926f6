"""Listings, counts and latencies over bids, events and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_catalogue(products: DataFrame, category: str | None = None) -> DataFrame:
    return (products.where(F.col("category") == category) if category else products).orderBy("category", "sku")


def list_bids(bids: DataFrame, statuses: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Bids by status and by words in client or reference, newest first."""
    out = bids.where(F.col("status").isin(statuses)) if statuses else bids
    if text:
        out = out.where(F.col("client").ilike(f"%{text}%") | F.col("reference").ilike(f"%{text}%"))
    return out.orderBy(F.desc("bid_date"), F.desc("bid_id"))


def list_observations(obs: DataFrame, mpn=None, competitor=None, adapter: str | None = None, limit: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest observations that fit all given filters, at most 1000."""
    for column, value in (("mpn", mpn), ("competitor_id", competitor), ("adapter", adapter)):
        if value is not None:
            obs = obs.where(F.col(column) == value)
    return obs.orderBy(F.desc("observed_on"), *ties).limit(min(limit, 1000))


def upcoming_deadlines(bids: DataFrame, today: Column, n: int = 5) -> DataFrame:
    return bids.where((F.col("due_date") >= today) & (F.col("status") != "rejected")).orderBy("due_date", "bid_id").limit(n)


def status_counts(bids: DataFrame) -> DataFrame:
    """Bids of each status and of all (A2)."""
    counts = bids.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.lit("total").alias("status"), F.sum("n").alias("n")))


def pipeline_values(bids: DataFrame) -> DataFrame:
    """Value under review, approved value, weighted revenue and mean margin, one row (A3)."""
    return bids.agg(
        F.sum(F.when(F.col("status") == "review", F.col("total"))).alias("review_value"), F.sum(F.when(F.col("status") == "approved", F.col("total"))).alias("approved_value"),
        F.sum(F.col("total") * F.col("win_probability")).alias("weighted_value"), F.avg("margin_pct").alias("mean_margin_pct"))


def stage_latency(runs: DataFrame) -> DataFrame:
    """Mean duration of each stage, cut to an integer; missing durations count as 0 (A5)."""
    return runs.groupBy("stage").agg(F.avg(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("mean_ms"))


def turnaround(runs: DataFrame) -> DataFrame:
    """Seconds from first start to last end of each key."""
    return runs.groupBy("key").agg((F.unix_timestamp(F.max("finished_at")) - F.unix_timestamp(F.min("started_at"))).alias("seconds"))


def intake_by_day(bids: DataFrame, column: str, last_day: Column, days: int = 14) -> DataFrame:
    """Counts of the last ``days`` days, zero where none."""
    calendar = bids.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    counts = bids.groupBy(F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts.hint("merge"), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def proposal_version(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One more than the completed runs before each run."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("version", F.coalesce(F.sum(F.col("completed").cast("long")).over(w), F.lit(0)) + 1)


def next_line_no(lines: DataFrame, added: DataFrame, order: list[str]) -> DataFrame:
    """Line numbers for added lines after the greatest one of the bid."""
    last = lines.groupBy("bid_id").agg(F.max("line_no").alias("_last"))
    w = Window.partitionBy("bid_id").orderBy(*order)
    return added.join(last, "bid_id", "left").withColumn("line_no", F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).drop("_last")


def dedupe_items(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first item of each description and quantity, renumbered within the bid."""
    w = Window.partitionBy("bid_id", *keys).orderBy(*order)
    first = items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.withColumn("line_no", F.row_number().over(Window.partitionBy("bid_id").orderBy(*order)))


def mark_duplicates(plan: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Second and later rows of a key are marked."""
    w = Window.partitionBy(key).orderBy(*order)
    return plan.withColumn("duplicate", F.row_number().over(w) > 1)


def share_of_total(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Part of the group's total; 1 where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.when(total == 0, 1.0).otherwise(F.col(value) / total))


def top_segments(bids: DataFrame) -> DataFrame:
    return bids.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "segment")


def throttle(events: DataFrame, limit: int = 8, seconds: int = 900) -> DataFrame:
    """Failures at which a key has ``limit`` of them within ``seconds`` since its last success (ST2, batch form)."""
    keyed = Window.partitionBy("key")
    successes = keyed.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("epoch", F.sum((F.col("kind") == "success").cast("long")).over(successes)).where("kind = 'failure'")
    w = Window.partitionBy("key", "epoch").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return rows.withColumn("failures", F.count(F.lit(1)).over(w)).where(F.col("failures") >= limit)


def expiry(plans: DataFrame, commits: DataFrame, ttl_s: int = 1800) -> DataFrame:
    """Each plan with the first commit within its time to live; without one it expired (ST7, batch form)."""
    within = (F.col("committed_at") >= F.col("created_at")) & (F.col("committed_at") < F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_s)))
    rows = plans.join(commits, "key", "left").withColumn("_at", F.when(within, F.col("committed_at")))
    return rows.groupBy("plan_id", "key", "created_at").agg(F.min("_at").alias("committed_at")).withColumn("expired", F.col("committed_at").isNull())


def bid_summary(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Flatten a JSON column: one output column a path, null where absent."""
    return rows.withColumns({name: F.get_json_object(column, path) for name, path in fields.items()})
