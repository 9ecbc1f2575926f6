"""Bid lines: overrides, tiers, value-adds, floors, mandated warranty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.operators.policy import Policy
from bidframe.sources.scratch import stored


def with_price_metrics(products: DataFrame) -> DataFrame:
    """Floor price and list margin (P5)."""
    floor = F.round(F.col("unit_cost") * (1 + F.col("min_margin_pct") / 100), 2)
    return products.withColumn("floor_price", floor).withColumn("list_margin_pct", 100 * (F.col("list_price") - F.col("unit_cost")) / F.col("list_price"))


def apply_overrides(lines: DataFrame, overrides: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, excluded)`` after reviewer choices; a null or inactive SKU is a reason to exclude."""
    joined = lines.join(overrides.select("bid_id", "line_no", F.col("sku").alias("_sku"), F.col("quantity").alias("_quantity"), "exclude"), ["bid_id", "line_no"], "left")
    chosen = joined.withColumn("sku", F.coalesce("_sku", "sku")).withColumn("quantity", F.coalesce("_quantity", "quantity"))
    active = products.where("active").select(F.col("sku").alias("_active"))
    chosen = chosen.join(active, F.col("sku") == F.col("_active"), "left")
    reason = F.when(F.col("exclude"), "Excluded by reviewer").when(F.col("sku").isNull(), "No catalogue match").when(
        F.col("_active").isNull(), F.concat(F.lit("SKU "), F.col("sku").cast("string"), F.lit(" inactive")))
    chosen = chosen.withColumn("reason", reason).drop("_sku", "_quantity", "_active", "exclude")
    return chosen.where("reason IS NULL").drop("reason"), chosen.where("reason IS NOT NULL")


def tier_discount(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``tier_discount_pct``: the highest tier reached; general tiers only for categories without any of their own.

    Tiers are a few rows a category, so both tables are broadcast: a shuffle
    of the lines by category would put them all into a few tasks.
    """
    own = tiers.where("category <> '*'").select("category").distinct().withColumn("_set", F.col("category"))
    keyed = lines.join(F.broadcast(own), "category", "left").withColumn("_set", F.coalesce("_set", F.lit("*")))
    steps = tiers.groupBy(F.col("category").alias("_set")).agg(F.sort_array(F.collect_list(F.struct("min_qty", "discount_pct"))).alias("_steps"))
    reached = F.filter("_steps", lambda s: s["min_qty"] <= F.col("quantity"))
    return keyed.join(F.broadcast(steps), "_set", "left").withColumn(
        "tier_discount_pct", F.coalesce(F.get(reached, F.size(reached) - 1)["discount_pct"], F.lit(0.0))).drop("_set", "_steps")


def eligible_value_adds(lines: DataFrame, value_adds: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Each line with each service for its category; percent rates apply to cost and list price."""
    # written, so that the join's strategy follows the true size of the exploded table
    offered = stored(value_adds.where(F.col("kind").isin(list(kinds))).withColumn("category", F.explode("categories")).drop("categories"), "offered")
    percent = F.col("basis") == "percent"
    return lines.join(offered, "category").withColumn(
        "bundle_cost", F.when(percent, F.col("unit_cost") * F.col("cost_rate") / 100).otherwise(F.col("cost_rate"))).withColumn(
        "bundle_value", F.when(percent, F.col("list_price") * F.col("value_rate") / 100).otherwise(F.col("value_rate")))


def offered_value_adds(lines: DataFrame, value_adds: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds ``offered``: the services for a line's category with their cost as an array, the rows of ``eligible_value_adds`` without more rows.

    Services are a few rows a category, so their table is broadcast and the
    lines stay where they are.
    """
    services = F.sort_array(F.collect_list(F.struct("code", "basis", "cost_rate", "warranty_extension_months")))
    per_category = value_adds.where(F.col("kind").isin(list(kinds))).withColumn("category", F.explode("categories")).groupBy("category").agg(services.alias("_services"))
    cost = lambda s: F.when(s["basis"] == "percent", F.col("unit_cost") * s["cost_rate"] / 100).otherwise(s["cost_rate"])
    offered = F.transform("_services", lambda s: F.struct(s["code"].alias("bundle"), cost(s).alias("bundle_cost"), s["warranty_extension_months"].alias("bundle_months")))
    return lines.join(F.broadcast(per_category), "category", "left").withColumn("offered", offered).drop("_services")


def cost_bid_lines(lines: DataFrame, products: DataFrame, tiers: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Lines with cost, floor, tiered standard price, stock and lead time (PR1; J5, J6, P5)."""
    policy = policy or Policy()
    joined = tier_discount(lines.join(with_price_metrics(products), "sku"), tiers)
    stock_ok = F.col("stock_qty") >= F.col("quantity")
    return joined.withColumn("standard_price", F.round(F.col("list_price") * (1 - F.col("tier_discount_pct") / 100), 2)).withColumn("stock_ok", stock_ok).withColumn(
        "lead_time_days", F.when(stock_ok, F.lit(policy.in_stock_lead_days)).otherwise(F.col("lead_time_days")))


def mandated_warranty(costed: DataFrame, extensions: DataFrame) -> DataFrame:
    """Price in the smallest, then cheapest, extension that closes the gap to ``need_months`` (PR2).

    Adds ``extension_code`` (null: none needed or none fits) and ``short``.
    """
    options = F.filter(
        F.col("_options"), lambda o: o["months"] >= F.col("need_months") - F.col("warranty_months"))
    per_category = stored(extensions.withColumn("category", F.explode("categories")).groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct(F.col("warranty_extension_months").alias("months"), "cost_rate", "value_rate", "code"))).alias("_options")), "options")
    rows = costed.join(per_category, "category", "left")
    needed = F.col("need_months") > F.col("warranty_months")
    rows = rows.withColumn("_pick", F.when(needed, F.get(options, F.lit(0))))
    extra_cost = F.coalesce(F.col("unit_cost") * F.col("_pick.cost_rate") / 100, F.lit(0.0))
    extra_value = F.coalesce(F.col("list_price") * F.col("_pick.value_rate") / 100, F.lit(0.0))
    return rows.withColumn("_cost", extra_cost).withColumn("_value", extra_value).withColumn("unit_cost", F.round(F.col("unit_cost") + F.col("_cost"), 2)).withColumn(
        "list_price", F.round(F.col("list_price") + F.col("_value"), 2)).withColumn(
        "standard_price", F.round(F.col("standard_price") + F.col("_value") * (1 - F.col("tier_discount_pct") / 100), 2)).withColumn(
        "floor_price", F.round(F.col("unit_cost") * (1 + F.col("min_margin_pct") / 100), 2)).withColumn(
        "warranty_months", F.col("warranty_months") + F.coalesce("_pick.months", F.lit(0))).withColumn("extension_code", F.col("_pick.code")).withColumn(
        "short", needed & F.col("_pick").isNull()).drop("_options", "_pick", "_cost", "_value")


def line_flags(priced: DataFrame) -> DataFrame:
    """Adds ``flags``."""
    checks = [
        (F.col("unit_price") < F.col("floor_price") - 1e-6, F.lit("Below margin floor")), (F.col("unit_price") < F.col("unit_cost"), F.lit("Loss-making price")),
        (~F.col("stock_ok"), F.concat(F.lit("Backorder: "), F.col("stock_qty").cast("string"), F.lit(" in stock"))), (F.col("win_probability") < 0.25, F.lit("Low win probability"))]
    return priced.withColumn("flags", F.array_compact(F.array(*(F.when(c, text) for c, text in checks))))


def bulk_adjust(lines: DataFrame, pct: float) -> DataFrame:
    return lines.withColumn("unit_price", F.round(F.col("unit_price") * (1 + pct / 100)))


def lift_to_floor(lines: DataFrame) -> DataFrame:
    least = F.ceil(F.col("floor_price") + F.col("bundle_cost")).cast("double")
    return lines.withColumn("unit_price", F.greatest("unit_price", F.when(F.col("unit_price") < F.col("floor_price") + F.col("bundle_cost"), least)))
