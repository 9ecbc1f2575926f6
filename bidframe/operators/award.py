"""Whole-bid award analysis: rivals, L1, quality-and-cost, auctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.operators.policy import Policy


def rival_totals(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Each competitor's total for a bid: its offer, else the line's median, else our revenue; coverage by revenue.

    ``lines``: bid_id, line_no, revenue, quantity, median_price; ``offers``:
    bid_id, line_no, competitor_id, unit_price. Lines that a competitor does
    not price are added from the bid's sums, so no competitor x line grid is
    made: a bid's defaults less those of the covered lines, plus the offers.
    """
    default = F.coalesce(F.col("median_price") * F.col("quantity"), F.col("revenue"))
    lines = lines.withColumn("_default", default)
    sums = lines.groupBy("bid_id").agg(F.sum("_default").alias("_all_default"), F.sum("revenue").alias("_all_revenue"))
    priced = offers.join(lines, ["bid_id", "line_no"]).groupBy("bid_id", "competitor_id").agg(
        F.sum(F.col("unit_price") * F.col("quantity")).alias("_offered"), F.sum("_default").alias("_replaced"), F.sum("revenue").alias("_covered"))
    return priced.join(sums, "bid_id").select(
        "bid_id", "competitor_id", F.round(F.col("_offered") + F.col("_all_default") - F.col("_replaced"), 7).alias("total"),  # equal totals stay equal
        (100 * F.col("_covered") / F.col("_all_revenue")).alias("coverage"))


def bid_cells(lines: DataFrame, least: float = 50.0) -> DataFrame:
    """Each bid's own sums and its serious rivals in one pass over its lines.

    ``lines``: bid_id, line_no, revenue, quantity, floor_price, unit_cost and
    ``offers``, an array of competitor_id and unit_price. Gives one row a bid
    with a null ``competitor_id`` (our_total, floor_total, cost_total) and one
    a serious rival (total, coverage), as ``rival_totals`` and
    ``serious_rivals`` do. Offers without a competitor or price do not count. All steps go by bid, so lines that lie together by
    bid are not shuffled again, and no line meets another one.
    """
    rows = lines.withColumn("offers", F.filter("offers", lambda o: o["competitor_id"].isNotNull() & o["unit_price"].isNotNull()))
    # of two offers of a competitor the lower one
    kept = F.filter("offers", lambda o, i: ~F.exists("offers", lambda x: (x["competitor_id"] == o["competitor_id"]) & (x["unit_price"] < o["unit_price"])) & ~F.exists(F.slice("offers", 1, i), lambda x: x == o))
    rows = rows.withColumn("offers", kept)
    nearest, half = F.array_sort(F.transform("offers", lambda o: o["unit_price"])), (F.size("offers") - 1) / 2
    median = (F.get(nearest, F.floor(half).cast("int")) + F.get(nearest, F.ceil(half).cast("int"))) / 2
    rows = rows.withColumn("_default", F.coalesce(median * F.col("quantity"), F.col("revenue")))
    own = F.struct(F.lit(None).cast("bigint").alias("competitor_id"), F.lit(None).cast("double").alias("unit_price"))
    value = lambda c: F.when(F.col("_o.competitor_id").isNull(), c)
    cells = rows.select("bid_id", "revenue", "quantity", "floor_price", "unit_cost", "_default", F.explode(F.concat(F.array(own), F.col("offers").cast("array<struct<competitor_id:bigint,unit_price:double>>"))).alias("_o"))
    sums = cells.groupBy("bid_id", F.col("_o.competitor_id").alias("competitor_id")).agg(
        F.sum(F.col("_o.unit_price") * F.col("quantity")).alias("_offered"), F.sum("_default").alias("_default"), F.sum("revenue").alias("_revenue"),
        F.sum(value(F.col("floor_price") * F.col("quantity"))).alias("floor_total"), F.sum(value(F.col("unit_cost") * F.col("quantity"))).alias("cost_total"))
    ours = F.col("competitor_id").isNull()
    w = Window.partitionBy("bid_id")
    whole = lambda c: F.max(F.when(ours, F.col(c))).over(w)
    cells = sums.withColumn("_all_default", whole("_default")).withColumn("_all_revenue", whole("_revenue"))
    cells = cells.withColumn("coverage", F.when(~ours, 100 * F.col("_revenue") / F.col("_all_revenue"))).withColumn("_top", F.max("coverage").over(w))
    return cells.where(ours | (F.col("coverage") >= least) | (F.col("_top") < least)).select(
        "bid_id", "competitor_id", F.when(~ours, F.round(F.col("_offered") + F.col("_all_default") - F.col("_default"), 7)).alias("total"), "coverage",
        F.when(ours, F.round("_revenue", 7)).alias("our_total"), "floor_total", "cost_total")


def ranked_bids(cells: DataFrame) -> DataFrame:
    """``bid_rank`` of the rows of ``bid_cells``, with each bid's own totals."""
    w = Window.partitionBy("bid_id")
    rows = cells.withColumn("_ours", F.max("our_total").over(w))
    below = F.sum((F.col("total") < F.col("_ours")).cast("long"))
    out = rows.groupBy("bid_id").agg(
        F.max("our_total").alias("our_total"), F.when(F.count("total") > 0, 1 + below).alias("rank"), F.min("total").alias("lowest_total"), F.max("floor_total").alias("floor_total"), F.max("cost_total").alias("cost_total"))
    return out.withColumn("gap_pct", 100 * (F.col("our_total") - F.col("lowest_total")) / F.col("lowest_total"))


def serious_rivals(totals: DataFrame, least: float = 50.0) -> DataFrame:
    """Rivals with enough coverage, or all where none has it."""
    w = Window.partitionBy("bid_id")
    return totals.withColumn("_top", F.max("coverage").over(w)).where((F.col("coverage") >= least) | (F.col("_top") < least)).drop("_top")


def topk_rivals(totals: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("bid_id").orderBy("total", "competitor_id")
    return totals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bid_rank(ours: DataFrame, rivals: DataFrame) -> DataFrame:
    """Our rank and the gap in percent to the lowest rival (W1); null without rivals."""
    joined = ours.join(rivals.select("bid_id", F.col("total").alias("_rival")), "bid_id", "left")
    return joined.groupBy("bid_id", "our_total").agg(
        F.when(F.count("_rival") > 0, 1 + F.sum((F.col("_rival") < F.col("our_total")).cast("long"))).alias("rank"), F.min("_rival").alias("lowest_total")).withColumn(
        "gap_pct", 100 * (F.col("our_total") - F.col("lowest_total")) / F.col("lowest_total"))


def uniform_discount(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """The smallest common cut that brings a bid to its target without breaking a floor (PR11).

    ``lines``: bid_id, line_no, price, floor_price, quantity; ``targets``:
    bid_id, target. A line stops falling at its break-point 1 - floor/price.
    In order of break-points, running sums of fixed and free value give the
    first piece in which the target lies. Adds ``discount`` and ``new_price``.
    """
    value, floor = F.col("price") * F.col("quantity"), F.least("price", "floor_price") * F.col("quantity")
    cut = F.when(F.col("price") > F.col("floor_price"), 1 - F.col("floor_price") / F.col("price")).otherwise(0.0)
    rows = lines.join(targets, "bid_id").withColumn("_cut", cut).withColumn("_value", value).withColumn("_floor", F.when(F.col("price") > F.col("floor_price"), floor).otherwise(value))
    w = Window.partitionBy("bid_id").orderBy("_cut", "line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("bid_id")
    fixed = F.coalesce(F.sum("_floor").over(upto), F.lit(0.0))
    free = F.sum("_value").over(whole) - F.coalesce(F.sum("_value").over(upto), F.lit(0.0))
    rows = rows.withColumn("_fixed", fixed).withColumn("_free", free)
    reach = F.col("_fixed") + F.col("_free") * (1 - F.col("_cut")) <= F.col("target")
    piece = F.when(reach & (F.col("_free") > 0), F.greatest(F.lit(0.0), 1 - (F.col("target") - F.col("_fixed")) / F.col("_free")))
    rows = rows.withColumn("_piece", piece)
    # the first piece in break-point order: a later one's formula does not hold below its own break-point
    found = F.min_by("_piece", F.when(F.col("_piece").isNotNull(), F.struct("_cut", "line_no"))).over(whole)
    rows = rows.withColumn("discount", F.coalesce(found, F.max("_cut").over(whole)))
    return rows.select(*lines.columns, "discount", F.when(F.col("price") > F.col("floor_price"), F.greatest(F.col("floor_price"), F.col("price") * (1 - F.col("discount")))).otherwise(F.col("price")).alias("new_price"))


def award_l1(bids: DataFrame, reached: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Lowest-price award (PR10).

    ``bids``: bid_id, our_total, cost_total, floor_total, rank, lowest_total,
    mse; ``reached``: bid_id, reached_total after the uniform discount.
    """
    policy = policy or Policy()
    rows = bids.join(reached, "bid_id", "left").withColumn("target_total", F.col("lowest_total") * (1 - policy.l1_undercut_pct / 100))
    within = F.col("our_total") <= F.col("lowest_total") * (1 + policy.mse_band_pct / 100)
    rows = rows.withColumn("target_feasible", F.col("reached_total") <= F.col("target_total") + 1).withColumn(
        "mse_match", F.col("mse") & (F.col("rank") > 1) & within & (F.col("lowest_total") > F.col("cost_total")))
    return rows.withColumn("recommendation", F.when(F.col("lowest_total").isNull() | (F.col("rank") == 1), "Submit as priced").when(
        F.col("target_feasible"), "Reprice to become L1").when(F.col("mse_match"), "Use the purchase preference").otherwise("Unlikely to win on price"))


def technical_score(met: Column, total: Column, deviations: Column) -> Column:
    """Estimated technical score; 80 where fewer than five clauses are mandatory."""
    return F.when(total >= 5, F.greatest(F.lit(40.0), F.least(F.lit(95.0), 55 + 40 * met / total - 3 * deviations))).otherwise(80.0)


def award_qcbs(bids: DataFrame, technical_weight: float = 70.0, policy: Policy | None = None) -> DataFrame:
    """Quality-and-cost award: combined scores and the highest total that still leads (PR12).

    ``bids``: bid_id, our_total, floor_total, lowest_total, technical. The root
    of the score difference is in closed form.
    """
    policy = policy or Policy()
    tw, fw = technical_weight, 100 - technical_weight
    t, r, ours = F.col("technical"), F.col("lowest_total"), F.col("our_total")
    low = F.least(ours, r)
    d = tw * (t - policy.rival_technical_score)
    cap = 1.3 * F.greatest(ours, r)
    root = F.when(d >= 0, F.when(fw * 100 - d > 0, F.least(cap, r * fw * 100 / (fw * 100 - d))).otherwise(cap)).otherwise(r * (1 + d / (fw * 100)))
    rows = bids.withColumn("our_score", (tw * t + fw * 100 * low / ours) / 100).withColumn("rival_score", (tw * policy.rival_technical_score + fw * 100 * low / r) / 100)
    rows = rows.withColumn("highest_winning_total", F.when(root > F.col("floor_total"), root))
    return rows.withColumn("recommendation", F.when(F.col("our_score") > F.col("rival_score"), "Submit as priced").when(
        F.col("highest_winning_total").isNotNull(), "Reprice to lead").otherwise("Compete on technical strength"))


def reverse_auction_bounds(bids: DataFrame) -> DataFrame:
    return bids.select("bid_id", F.col("our_total").alias("opening"), F.col("floor_total").alias("walk_away"))


def award_options(bids: DataFrame) -> DataFrame:
    """Rows of label, total, margin and feasibility for the totals of each bid."""
    totals = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).alias("total")) for label, c in (("As priced", "our_total"), ("Lowest rival", "lowest_total"), ("Floor", "floor_total"))))
    rows = bids.withColumn("_o", F.explode(totals)).where("_o.total IS NOT NULL")
    margin = F.col("_o.total") - F.col("cost_total")
    return rows.select("bid_id", "_o.label", "_o.total", margin.alias("margin"), (100 * margin / F.nullif(F.col("_o.total"), F.lit(0.0))).alias("margin_pct"), (F.col("_o.total") >= F.col("floor_total") - 1).alias("feasible"))
