"""Exchange rates, tax rules and treatment, quotes in local currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import round_money
from bidframe.operators.policy import Policy


def fx_convert(df: DataFrame, rates: DataFrame, amount: str, source: str, target: str) -> DataFrame:
    """Adds ``converted``: the amount by the cross rate through the base; unknown currencies drop the row.

    ``rates``: currency, rate (units for one unit of the base).
    """
    a = rates.select(F.col("currency").alias("_from"), F.col("rate").alias("_from_rate"))
    b = rates.select(F.col("currency").alias("_to"), F.col("rate").alias("_to_rate"))
    joined = df.join(a, F.col(source) == F.col("_from"), "left").join(b, F.col(target) == F.col("_to"), "left")
    same = F.col(source) == F.col(target)
    return joined.where(same | (F.col("_from_rate").isNotNull() & F.col("_to_rate").isNotNull())).withColumn(
        "converted", F.when(same, F.col(amount)).otherwise(F.col(amount) * F.col("_to_rate") / F.col("_from_rate"))).drop("_from", "_from_rate", "_to", "_to_rate")


def fx_table(candidates: DataFrame, ttl_s: int, now: Column, least_rates: int = 10) -> DataFrame:
    """The source of each base's rates: fresh cache, live, stale cache, reference (PR16).

    ``candidates``: base, source (live, cache, reference), fetched_at, rates (map).
    """
    fresh = F.col("fetched_at") >= now - F.make_dt_interval(secs=F.lit(ttl_s))
    rank = F.when((F.col("source") == "cache") & fresh, 1).when((F.col("source") == "live") & (F.size("rates") >= least_rates), 2).when(F.col("source") == "cache", 3).when(F.col("source") == "reference", 4)
    w = Window.partitionBy("base").orderBy("_rank", F.desc("fetched_at"))
    rows = candidates.withColumn("_rank", rank).where("_rank IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.withColumn("stale", F.col("_rank") >= 3).drop("_rank", "_n")


def tax_rule_for(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the most specific rule of the line's country: region and category, region, category, country; table order breaks ties.

    Rules are joined by four keys of equality, so a large rule table needs no
    theta join and a line meets at most one rule a key.
    """
    out = lines
    levels = [("region", "tax_category"), ("region", None), (None, "tax_category"), (None, None)]
    for k, (region, category) in enumerate(levels):
        level = rules.where(F.col("region").isNotNull() if region else F.col("region").isNull()).where(F.col("tax_category") != "*" if category else F.col("tax_category") == "*")
        keys = ["country", *([region] if region else []), *([category] if category else [])]
        first = level.groupBy(*keys).agg(F.min_by(F.struct("name", "rate_pct"), "rule_no").alias(f"_r{k}"))
        out = out.join(first, keys, "left")
    return out.withColumn("rule", F.coalesce(*(f"_r{k}" for k in range(4)))).drop(*(f"_r{k}" for k in range(4)))


def tax_treatment(lines: DataFrame, default_rate: float = 18.0) -> DataFrame:
    """Adds ``treatment`` and ``components`` (name, rate) of each line (PR14).

    ``lines`` have supplier_country, supplier_region, country, region,
    incoterm, tax_category, has_tax_id and ``rule`` of the destination.
    """
    home = F.col("supplier_country") == F.col("country")
    india = home & (F.col("country") == "IN")
    rate = F.coalesce(F.col("rule.rate_pct"), F.when(india, F.lit(default_rate)), F.lit(0.0))
    reverse = ~home & (F.col("incoterm") == "DDP") & F.col("tax_category").isin("services", "software") & F.col("has_tax_id") & (F.col("country") != "US")
    treatment = F.when(india & (F.col("supplier_region") == F.col("region")), "intra-state").when(india, "inter-state").when(home, "domestic").when(
        F.col("incoterm") != "DDP", "zero-rated export").when(reverse, "reverse charge").when(F.col("rule").isNull(), "no rule").otherwise("destination")

    def part(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.alias("rate_pct"))

    components = F.when(treatment == "intra-state", F.array(part(F.lit("CGST"), rate / 2), part(F.lit("SGST"), rate / 2))).when(
        treatment == "inter-state", F.array(part(F.lit("IGST"), rate))).when(
        treatment.isin("domestic", "destination"), F.array(part(F.coalesce(F.col("rule.name"), F.lit("Tax")), rate))).otherwise(F.array(part(F.lit("Tax"), F.lit(0.0))))
    return lines.withColumn("treatment", treatment).withColumn("components", components)


def localise(lines: DataFrame, base: str = "INR", policy: Policy | None = None) -> DataFrame:
    """Unit price, net, tax of each component and gross in the quote's currency (PR15).

    ``lines``: price (base), quantity, currency, fx_rate, components. The unit
    is rounded first, then the net, then each tax.
    """
    policy = policy or Policy()
    effective = F.col("fx_rate") * (1 + F.when(F.col("currency") == base, 0.0).otherwise(policy.fx_buffer_pct) / 100)
    rows = lines.withColumn("effective_rate", effective).withColumn("unit_local", round_money(F.col("price") * F.col("effective_rate"), F.col("currency")))
    rows = rows.withColumn("net", round_money(F.col("unit_local") * F.col("quantity"), F.col("currency")))
    taxes = F.transform("components", lambda c: F.struct(c["name"].alias("name"), c["rate_pct"].alias("rate_pct"), round_money(F.col("net") * c["rate_pct"] / 100, F.col("currency")).alias("amount")))
    rows = rows.withColumn("taxes", taxes)
    return rows.withColumn("tax", F.aggregate("taxes", F.lit(0.0), lambda acc, x: acc + x["amount"])).withColumn("gross", F.col("net") + F.col("tax"))


def tax_breakdown(localised: DataFrame, keys: list[str]) -> DataFrame:
    """Amounts by component and rate; zero amounts stay only for zero rates."""
    rows = localised.select(*keys, F.explode("taxes").alias("t")).groupBy(*keys, F.col("t.name").alias("name"), F.col("t.rate_pct").alias("rate_pct")).agg(F.sum("t.amount").alias("amount"))
    return rows.where((F.col("amount") != 0) | (F.col("rate_pct") == 0))


def quote_totals(localised: DataFrame) -> DataFrame:
    """Subtotal, tax, total and total in base of each bid."""
    return localised.groupBy("bid_id").agg(F.sum("net").alias("subtotal"), F.sum("tax").alias("tax"), F.sum("gross").alias("total"), F.sum(F.col("gross") / F.col("effective_rate")).alias("total_base"))
