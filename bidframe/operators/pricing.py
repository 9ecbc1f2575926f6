"""Price search: grid, feasibility, win probability, choice, scenarios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import clamp, price_sensitivity
from bidframe.operators.policy import LEAD_CLIP, SEGMENTS, WARRANTY_CLIP, Policy, WinModel

LINE = ["bid_id", "line_no"]
_CHOICES = "array<struct<bundle:string,bundle_cost:double,bundle_months:int>>"
#: Lines of which the whole grid is held at once in ``best_config``.
_TILE = 2_048
UNBUNDLED = "Best price without a bundle"


def bid_features(df: DataFrame) -> DataFrame:
    """Adds the fourteen features of the win model (M1)."""
    gap = F.col("price_ratio") - 1.0
    out = {"gap": gap} | {f"gap_{s}": gap * (F.col("segment") == s).cast("double") for s in SEGMENTS}
    out |= {"warranty_years": clamp(F.col("warranty_delta_months"), -WARRANTY_CLIP, WARRANTY_CLIP) / 12.0, "lead_weeks": clamp(F.col("lead_time_delta_days"), -LEAD_CLIP, LEAD_CLIP) / 7.0,
            "bundled": F.col("bundled_value_add").cast("double"), "repeat": F.col("repeat_customer").cast("double")}
    out |= {f"is_{s}": (F.col("segment") == s).cast("double") for s in SEGMENTS[1:]}
    return df.withColumns(out)


def price_slope(segment: Column, model: WinModel) -> Column:
    """Weight of the relative price gap in a segment."""
    slope = F.lit(model.gap)
    for s, w in zip(SEGMENTS, model.gap_by_segment):
        slope = slope + F.when(segment == s, w).otherwise(0.0)
    return slope


def win_log_odds(price_ratio: Column, warranty_delta: Column, lead_delta: Column, bundled: Column, repeat: Column, segment: Column, model: WinModel) -> Column:
    m = model
    z = F.lit(m.intercept) + (price_ratio - 1.0) * price_slope(segment, m) + m.warranty * clamp(warranty_delta, -WARRANTY_CLIP, WARRANTY_CLIP) / 12.0 + m.lead * clamp(lead_delta, -LEAD_CLIP, LEAD_CLIP) / 7.0
    z = z + m.bundle * bundled.cast("double") + m.repeat * repeat.cast("double")
    for s, w in zip(SEGMENTS[1:], m.segment):
        z = z + F.when(segment == s, w).otherwise(0.0)
    return z


def win_probability(price_ratio: Column, warranty_delta: Column, lead_delta: Column, bundled: Column, repeat: Column, segment: Column, model: WinModel | None = None) -> Column:
    """Logistic win probability in closed form, no model call for a row (M3)."""
    return 1.0 / (1.0 + F.exp(-win_log_odds(price_ratio, warranty_delta, lead_delta, bundled, repeat, segment, model or WinModel())))


def price_configs(lines: DataFrame, bundles: DataFrame | None, policy: Policy | None = None) -> DataFrame:
    """Lines x price grid x {none, bundles}.

    Bundles only where the best rival is below cost and the award is not L1.
    Adds ``idx, price, bundle, bundle_cost, bundle_months``. Rows grow by the
    grid's points times a line's few services, all in one stage.
    """
    policy = policy or Policy()
    rows, kept = _with_choices(lines, bundles)
    rows = rows.withColumn("_choice", F.explode("_choices")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(policy.price_grid_points - 1))))
    return rows.select(*kept, "idx", grid_price(policy).alias("price"), "_choice.bundle", "_choice.bundle_cost", "_choice.bundle_months")


def grid_price(policy: Policy, idx: str = "idx") -> Column:
    """Price of grid point ``idx`` between floor and list price."""
    return F.round(F.col("floor_price") + (F.greatest("floor_price", "list_price") - F.col("floor_price")) * F.col(idx) / (policy.price_grid_points - 1), 2)


def _with_choices(lines: DataFrame, bundles: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """``_choices`` of each line, no bundle first, and the names of the line's own columns.

    Bundles come from the array ``offered`` where lines carry it, else from
    ``bundles`` by line.
    """
    kept = [c for c in lines.columns if c != "offered"]
    if bundles is not None:
        offered = bundles.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct(F.col("code").alias("bundle"), "bundle_cost", F.col("warranty_extension_months").alias("bundle_months")))).alias("offered"))
        lines = lines.select(*kept).join(offered.hint("merge"), LINE, "left")
    none = F.array(F.struct(F.lit(None).cast("string").alias("bundle"), F.lit(0.0).alias("bundle_cost"), F.lit(0).alias("bundle_months"))).cast(_CHOICES)
    if "offered" not in lines.columns:
        return lines.withColumn("_choices", none), kept
    wanted = (F.col("best_price") < F.col("unit_cost")) & (F.col("award") != "L1") & F.col("offered").isNotNull()
    return lines.withColumn("_choices", F.when(wanted, F.concat(none, F.col("offered").cast(_CHOICES))).otherwise(none)), kept


def feasible(policy: Policy | None = None) -> Column:
    """Above the floor; a bundle is paid from margin above it and capped as a share of the price."""
    policy = policy or Policy()
    low = F.col("floor_price") - 1e-6
    return (F.col("price") >= low) & (F.col("bundle").isNull() | ((F.col("price") - F.col("bundle_cost") >= low) & (F.col("bundle_cost") <= F.col("price") * policy.max_bundle_cost_share_pct / 100)))


def _log_odds(ratio: Column, bundle: Column, months: Column, model: WinModel) -> Column:
    l1 = F.col("award") == "L1"
    return win_log_odds(
        ratio, F.when(l1, 0).otherwise(F.col("warranty_months") + months - F.col("best_warranty")), F.when(l1, 0).otherwise(F.col("lead_time_days") - F.col("best_lead")),
        ~l1 & bundle.isNotNull(), ~l1 & F.col("repeat_customer"), F.col("segment"), model)


def scored(cfg: DataFrame, model: WinModel | None = None) -> DataFrame:
    """Adds ``win_probability`` and ``expected_profit``; under L1 service terms earn nothing."""
    ratio = 1 + (F.col("price") / F.col("best_price") - 1) * price_sensitivity(F.col("price_weight"))
    z = _log_odds(ratio, F.col("bundle"), F.col("bundle_months"), model or WinModel())
    out = cfg.withColumn("win_probability", 1.0 / (1.0 + F.exp(-z)))
    return out.withColumn("expected_profit", (F.col("price") - F.col("unit_cost") - F.col("bundle_cost")) * F.col("quantity") * F.col("win_probability"))


def choose_config(cfg: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The best configuration of each line.

    Among those with enough win probability the largest expected profit in
    cents, then probability; without any the largest probability in four
    decimals, then expected profit. Adds ``best_effort``. One aggregation over
    the grid with map-side combine: no window has to hold a line's grid.
    """
    policy = policy or Policy()
    viable = F.col("win_probability") >= policy.min_target_win_probability
    e, p = F.col("expected_profit"), F.col("win_probability")
    order = F.struct(
        viable.alias("viable"), F.when(viable, F.round(e, 2)).otherwise(F.round(p, 4)).alias("a"), F.when(viable, p).otherwise(e).alias("b"),
        F.coalesce("bundle", F.lit("")).alias("c"), (-F.col("idx")).alias("d"))
    keep = F.struct("price", "bundle", "bundle_cost", "win_probability", "expected_profit", "idx")
    return cfg.groupBy(*LINE).agg(F.max_by(keep, order).alias("k"), F.max(viable).alias("any")).select(*LINE, "k.*", (~F.col("any")).alias("best_effort"))


def classify_strategy(policy: Policy | None = None) -> Column:
    """Name of the pricing strategy of a chosen line (PR4)."""
    policy = policy or Policy()
    best, price = F.col("best_price"), F.col("price")
    bundled = F.when(F.col("bundle").isNotNull(), "Value differentiation").otherwise("Floor defence")
    return F.when((best < F.col("unit_cost")) | (best < F.col("floor_price")), bundled).when(
        (best >= F.col("standard_price")) & (price >= F.col("standard_price")), "Margin capture").when(price < best * 0.9995, "Competitive undercut").when(
        price <= best * (1 + policy.match_band_pct / 100), "Price match").otherwise("Premium position")


def best_config(policy: Policy):
    """Arrow function of a line's floor, high price, cost, quantity, price ratio's slope and choices: position of the best choice and its grid point.

    The rule is that of ``choose_config``; halves of a cent are rounded up.
    Both are null where no configuration is feasible.
    """
    n, share, least = policy.price_grid_points, policy.max_bundle_cost_share_pct / 100, policy.min_target_win_probability
    lowest = -np.finfo(np.float64).max  # unknown, but above infeasible

    def rounded(x: np.ndarray, scale: float) -> np.ndarray:
        return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale

    def tile(floor, high, cost, quantity, steep, choices):
        count = np.diff(choices.offsets.to_numpy())
        flat, line = choices.flatten(), np.repeat(np.arange(len(count)), count)
        bundle, extra, z = (flat.field(f) for f in ("bundle", "bundle_cost", "z"))
        extra, z = (x.to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for x in (extra, z))
        price = rounded(floor[:, None] + (high - floor)[:, None] * np.arange(n) / (n - 1), 100.0)[line]
        low = (floor - 1e-6)[line][:, None]
        some = bundle.is_valid().to_numpy(zero_copy_only=False)[:, None]
        ok = (price >= low) & (~some | ((price - extra >= low) & (extra <= price * share)))
        p = 1.0 / (1.0 + np.exp(-(z + steep[line][:, None] * price)))
        e = (price - cost[line][:, None] - extra) * quantity[line][:, None] * p
        viable = ok & (p >= least)
        any_viable = viable.any(axis=1)
        first = np.where(any_viable[:, None], rounded(e, 100.0), rounded(p, 10_000.0))
        second = np.where(any_viable[:, None], p, e)
        first = np.where(np.where(any_viable[:, None], viable, ok), np.where(np.isnan(first), lowest, first), -np.inf)
        a = first.max(axis=1)
        second = np.where((first == a[:, None]) & (a > -np.inf)[:, None], np.where(np.isnan(second), lowest, second), -np.inf)
        idx = second.argmax(axis=1)
        b = second[np.arange(len(idx)), idx]
        codes, rank = np.unique(np.array([x or "" for x in bundle.to_pylist()], dtype=object), return_inverse=True)
        order = np.lexsort((-idx, rank, b, a, any_viable, line))  # the last of each line is its best
        best = order[np.cumsum(count) - 1]
        found = a[best] > -np.inf
        return np.where(found, best - (np.cumsum(count) - count), -1), np.where(found, idx[best], -1)

    def pick(floor: pa.Array, high: pa.Array, cost: pa.Array, quantity: pa.Array, steep: pa.Array, choices: pa.Array) -> pa.Array:
        numbers = [x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (floor, high, cost, quantity, steep)]
        at, idx = [], []
        with np.errstate(all="ignore"):
            for start in range(0, len(choices), _TILE):
                one = choices.slice(start, _TILE)
                found = tile(*(x[start:start + _TILE] for x in numbers), pa.ListArray.from_arrays(pa.array(one.offsets.to_numpy() - one.offsets[0].as_py(), pa.int32()), one.flatten()))
                at.append(found[0])
                idx.append(found[1])
        at, idx = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, idx))
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32), mask=at < 0) for x in (at, idx)], ["at", "idx"])

    # evaluated once: a filter on its result must not call it again
    return F.arrow_udf(pick, "at int, idx int").asNondeterministic()


def optimise_prices(lines: DataFrame, bundles: DataFrame | None, policy: Policy | None = None, model: WinModel | None = None) -> DataFrame:
    """Chosen price, bundle, probability, profit and strategy of each line (PR3).

    The grid of a line is searched where the line lies: neither its points
    nor its bundles become rows, and nothing is shuffled. Services come from
    the array ``offered`` of ``lines`` (``costing.offered_value_adds``) or
    from ``bundles``, one row a line and service.
    """
    policy, model = policy or Policy(), model or WinModel()
    rows, kept = _with_choices(lines, bundles)
    # the log-odds are linear in the price: the constant part of each choice, and the price's weight
    steep = price_slope(F.col("segment"), model) * price_sensitivity(F.col("price_weight"))
    # without the gap, the odds at the rival's own price; the gap's share is steep * (price / best_price - 1)
    odds = lambda c: _log_odds(F.lit(1.0), c["bundle"], c["bundle_months"], model) - steep
    choices = F.transform("_choices", lambda c: F.struct(c["bundle"].alias("bundle"), c["bundle_cost"].alias("bundle_cost"), odds(c).alias("z")))
    number = lambda c: c.cast("double")
    picked = best_config(policy)(number(F.col("floor_price")), number(F.greatest("floor_price", "list_price")), number(F.col("unit_cost")), number(F.col("quantity")), steep / F.col("best_price"), choices)
    rows = rows.withColumn("_pick", picked).where("_pick.at IS NOT NULL").withColumn("_choice", F.get("_choices", F.col("_pick.at"))).withColumn("idx", F.col("_pick.idx"))
    chosen = scored(rows.select(*kept, grid_price(policy).alias("price"), "_choice.bundle", "_choice.bundle_cost", "_choice.bundle_months", "idx"), model)
    return chosen.withColumn("best_effort", F.col("win_probability") < policy.min_target_win_probability).withColumn("strategy", classify_strategy(policy))


def no_market_price(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Lines without any offer: standard price at even odds (PR8)."""
    alone = lines.join(offers.select("mpn").distinct(), lines.sku == F.col("mpn"), "left_anti")
    return alone.withColumn("price", F.col("standard_price")).withColumn("win_probability", F.lit(0.5)).withColumn("strategy", F.lit("Standard pricing"))


def assess_prices(proposals: DataFrame, policy: Policy | None = None, model: WinModel | None = None) -> DataFrame:
    """What-if rows with feasibility, issues, margin, probability and distance to the best rival (PR5)."""
    policy = policy or Policy()
    rows = scored(proposals, model).withColumn("feasible", feasible(policy)).withColumn("strategy", classify_strategy(policy))
    issues = F.array_compact(F.array(
        F.when(F.col("price") < F.col("floor_price") - 1e-6, "below the margin floor"),
        F.when(F.col("bundle").isNotNull() & (F.col("price") - F.col("bundle_cost") < F.col("floor_price") - 1e-6), "bundle not funded above the floor"),
        F.when(F.col("bundle").isNotNull() & (F.col("bundle_cost") > F.col("price") * policy.max_bundle_cost_share_pct / 100), "bundle above its share of the price")))
    return rows.withColumn("issues", issues).withColumn("margin_pct", 100 * (F.col("price") - F.col("unit_cost") - F.col("bundle_cost")) / F.col("price")).withColumn(
        "vs_best_pct", 100 * (F.col("price") / F.col("best_price") - 1))


def best_unbundled(policy: Policy):
    """Arrow function of a line's floor, high price, cost, quantity, price ratio's slope and log-odds without a price: grid point of its best price without a bundle.

    Among prices with enough win probability the largest expected profit, else
    the largest probability; the lowest of equal ones. Null where the floor is.
    """
    n, least = policy.price_grid_points, policy.min_target_win_probability

    def pick(floor: pa.Array, high: pa.Array, cost: pa.Array, quantity: pa.Array, steep: pa.Array, z: pa.Array) -> pa.Array:
        asked = np.nonzero(floor.is_valid().to_numpy(zero_copy_only=False))[0]
        out = np.full(len(floor), -1, np.int32)
        numbers = [x.to_numpy(zero_copy_only=False).astype(np.float64)[asked, None] for x in (floor, high, cost, quantity, steep, z)]
        with np.errstate(all="ignore"):
            for at in range(0, len(asked), _TILE):
                low, top, c, q, s, odds = (x[at:at + _TILE] for x in numbers)
                price = np.floor((low + (top - low) * np.arange(n) / (n - 1)) * 100.0 + 0.5) / 100.0
                p = 1.0 / (1.0 + np.exp(-(odds + s * price)))
                viable = p >= least
                value = np.where(viable.any(axis=1)[:, None], np.where(viable, (price - c) * q * p, -np.inf), p)
                out[asked[at:at + _TILE]] = np.where(np.isnan(value), -np.inf, value).argmax(axis=1)
        return pa.array(out, mask=out < 0)

    return F.arrow_udf(pick, "int").asNondeterministic()


def price_scenarios(priced: DataFrame, model: WinModel | None = None, policy: Policy | None = None) -> DataFrame:
    """Recommended, match-best, standard, floor and best unbundled scenarios of each line, one a price (PR6, U3).

    A line whose chosen price carries a bundle has a fifth scenario, the best
    price of its grid without one; ``policy`` gives that grid, and without it
    the scenario is left out. It takes over the label of an equal offer.
    """
    model = model or WinModel()
    none = F.lit(None).cast("string")
    offers = [
        ("Recommended", F.col("price"), F.col("bundle")), ("Match best competitor", F.round("best_price", 2), none),
        ("Standard price", F.col("standard_price"), none), ("Margin floor", F.col("floor_price"), none)]
    base = priced.drop("price", "bundle", "bundle_cost", "bundle_months", "win_probability", "expected_profit")
    months = F.col("bundle_months") if "bundle_months" in priced.columns else F.lit(0)
    rows = priced.withColumn("_months", months)
    if policy is not None:
        number = lambda c: c.cast("double")
        steep = price_slope(F.col("segment"), model) * price_sensitivity(F.col("price_weight"))
        odds = _log_odds(F.lit(1.0), none, F.lit(0), model) - steep
        bundled_floor = F.when(F.col("bundle").isNotNull(), number(F.col("floor_price")))
        found = best_unbundled(policy)(bundled_floor, number(F.greatest("floor_price", "list_price")), number(F.col("unit_cost")), number(F.col("quantity")), steep / F.col("best_price"), odds)
        rows = rows.withColumn("_at", found).withColumn("_unbundled", grid_price(policy, "_at"))
        offers.append((UNBUNDLED, F.col("_unbundled"), none))
    kinds = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(label).alias("label"), price.alias("price"), bundle.alias("bundle")) for k, (label, price, bundle) in enumerate(offers)))
    if policy is not None:
        kinds = F.when(F.col("_at").isNull(), F.slice(kinds, 1, len(offers) - 1)).otherwise(kinds)
    same = lambda s, t: t["price"].eqNullSafe(s["price"]) & t["bundle"].eqNullSafe(s["bundle"])
    # the first of equal prices stays, in the row: a few scenarios a line need no window
    first = F.filter("_all", lambda s, i: ~F.exists(F.slice("_all", 1, i), lambda t: same(s, t)))
    label = lambda s: F.when(F.exists("_all", lambda t: (t["label"] == UNBUNDLED) & same(s, t)), UNBUNDLED).otherwise(s["label"])
    if policy is not None:
        first = F.transform(first, lambda s: F.struct(s["rank"].alias("rank"), label(s).alias("label"), s["price"].alias("price"), s["bundle"].alias("bundle")))
    rows = rows.select(*base.columns, F.col("bundle_cost").alias("_cost"), "_months", kinds.alias("_all")).select(*base.columns, "_cost", "_months", F.explode(first).alias("s")).select(*base.columns, "_cost", "_months", "s.*")
    bundled = F.col("bundle").isNotNull()
    rows = rows.withColumn("bundle_cost", F.when(bundled, F.col("_cost")).otherwise(0.0)).withColumn("bundle_months", F.when(bundled, F.col("_months")).otherwise(0)).drop("_cost", "_months")
    return scored(rows, model)


def win_curve(cfg: DataFrame, points: int) -> DataFrame:
    """Every ``points // 30``-th grid point, and the last."""
    step = max(1, points // 30)
    return cfg.where((F.col("idx") % step == 0) | (F.col("idx") == points - 1))


def apply_price_overrides(priced: DataFrame, overrides: DataFrame) -> DataFrame:
    """A reviewer's price wins; locked lines keep theirs (PR7)."""
    o = overrides.select(*LINE, F.col("price").alias("_price"), "locked")
    joined = priced.join(o, LINE, "left")
    wins = F.col("_price").isNotNull() & ~F.coalesce("locked", F.lit(False))
    return joined.withColumn("strategy", F.when(wins, "Reviewer override").otherwise(F.col("strategy"))).withColumn(
        "price", F.when(wins, F.col("_price")).otherwise(F.col("price"))).drop("_price", "locked")


def bid_totals(priced: DataFrame) -> DataFrame:
    """Revenue, cost, margin, expected profit and revenue-weighted probability of each bid."""
    revenue, bundle = F.col("price") * F.col("quantity"), F.col("bundle_cost") * F.col("quantity")
    cost = F.col("unit_cost") * F.col("quantity")
    sums = priced.groupBy("bid_id").agg(
        F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost"), F.sum(bundle).alias("bundle_cost"), F.sum("expected_profit").alias("expected_profit"),
        F.sum(revenue * F.col("win_probability")).alias("_weighted"), F.sum((F.col("best_price") < F.col("unit_cost")).cast("long")).alias("rivals_below_cost"))
    margin = F.col("revenue") - F.col("cost") - F.col("bundle_cost")
    return sums.withColumn("margin", margin).withColumn("margin_pct", F.when(F.col("revenue") != 0, 100 * margin / F.col("revenue")).otherwise(0.0)).withColumn(
        "win_probability", F.when(F.col("revenue") != 0, F.col("_weighted") / F.col("revenue")).otherwise(0.0)).drop("_weighted")


def modal_strategy(priced: DataFrame) -> DataFrame:
    """The most frequent strategy of each bid; the one seen first wins ties (A10)."""
    counts = priced.groupBy("bid_id", "strategy").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return counts.groupBy("bid_id").agg(F.max_by("strategy", F.struct("n", -F.col("first"))).alias("strategy"))


def strategy_mix(priced: DataFrame) -> DataFrame:
    return priced.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "strategy")


def price_position(lines: DataFrame) -> DataFrame:
    """Scale bounds of each line's own and rival prices."""
    return lines.groupBy(*LINE).agg((0.975 * F.min(F.least("price", "rival_price"))).alias("low"), (1.025 * F.max(F.greatest("price", "rival_price"))).alias("high"))


def key_lines(priced: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` lines of a bid to look at: flagged ones by revenue first, then others by revenue.

    Revenues are compared in four decimals: equal ones must not be told apart
    by binary noise.
    """
    w = Window.partitionBy("bid_id").orderBy(F.desc((F.size("flags") > 0).cast("int")), F.desc(F.round(F.col("price") * F.col("quantity"), 4)), "line_no")
    return priced.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def preview_economics(lines: DataFrame) -> DataFrame:
    """Revenue, margin and lines below the floor of each bid."""
    return lines.groupBy("bid_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("revenue"), F.sum((F.col("price") - F.col("unit_cost")) * F.col("quantity")).alias("margin"),
        F.sum((F.col("price") < F.col("floor_price")).cast("long")).alias("below_floor"))


def bid_verdict(bids: DataFrame) -> DataFrame:
    """Strong, Competitive or Stretch; a failed compliance review overrides (PR22)."""
    p, m, l1 = F.col("win_probability"), F.col("margin_pct"), F.coalesce(F.col("rank") == 1, F.lit(False))
    verdict = F.when(F.col("recommendation") == "Do not bid", "Do not bid").when(((p >= 0.55) & (m >= 10)) | (l1 & (m >= 5)), "Strong").when((p >= 0.35) | l1, "Competitive").otherwise("Stretch")
    return bids.withColumn("verdict", verdict)
