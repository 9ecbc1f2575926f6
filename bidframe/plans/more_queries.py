"""Registered queries of reports, functions, set operations and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.functions import scalars, text
from bidframe.operators import costing, ledger, market, monitor, pricing, tender
from bidframe.operators.policy import Policy
from bidframe.plans.bindings import TIERS, bound, cte, priced_lines, table, tiers, values
from bidframe.plans.queries import _TABLES, GRID_SQL, PRICED_SQL, TIER_SQL, _costed, _optimised, query


@query("category_scope", f"""WITH {cte('lines', 'products')}, g AS (SELECT bid_id, category, sum(quantity) AS q FROM lines JOIN products USING (sku) GROUP BY 1, 2)
SELECT bid_id, category, CAST(q AS BIGINT) AS quantity, CAST(row_number() OVER (PARTITION BY bid_id ORDER BY CAST(category IN ('T3') AS INT), q DESC, category) AS INT) AS position FROM g""")
def q_scope(spark, d):
    rows = bound(spark, d, "lines").join(bound(spark, d, "products").select("sku", "category"), "sku")
    return tender.category_scope(rows, ("T3",)).select("bid_id", "category", F.col("quantity").cast("long").alias("quantity"), "position")


@query("delivery_extremes", f"""WITH {cte('lines', 'products')}, {TIER_SQL} SELECT bid_id, CAST(max(lead_time_days) AS INT) AS lead_time_days, CAST(min(warranty_months) AS INT) AS warranty_months,
CAST(max(lead_time_days) + CASE WHEN bid_id % 2 = 0 THEN 2 ELSE 6 END + CASE WHEN bool_or(category = 'T1') THEN 5 ELSE 0 END AS INT) AS completion_days FROM cl GROUP BY bid_id""")
def q_delivery(spark, d):
    return tender.delivery_extremes(_costed(spark, d), F.col("bid_id") % 2 == 0, F.col("category") == "T1")


@query("market_digest", f"WITH {_TABLES}, {PRICED_SQL}, {GRID_SQL} SELECT bid_id, count(*) AS lines, CAST(sum(CAST(best_price < unit_cost AS INT)) AS BIGINT) AS rivals_below_cost, count(DISTINCT strategy) AS strategies FROM opt GROUP BY 1")
def q_digest(spark, d):
    return tender.market_digest(_optimised(spark, d)).select("bid_id", "lines", "rivals_below_cost", F.size("strategies").cast("long").alias("strategies"))


@query("bundle_inclusions", f"WITH {_TABLES}, {PRICED_SQL}, {GRID_SQL} SELECT bid_id, bundle, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(bundle_cost * quantity), 4) AS value FROM opt WHERE bundle IS NOT NULL GROUP BY 1, 2")
def q_inclusions(spark, d):
    return tender.bundle_inclusions(_optimised(spark, d)).select("bid_id", "bundle", F.size("lines").cast("long").alias("lines"), F.col("quantity").cast("long").alias("quantity"), F.round("value", 4).alias("value"))


@query("price_scenarios", f"""WITH {_TABLES}, {PRICED_SQL}, {GRID_SQL}, nb AS (SELECT bid_id, line_no, price, row_number() OVER (PARTITION BY bid_id, line_no ORDER BY p >= 0.2 DESC, CASE WHEN p >= 0.2 THEN e ELSE p END DESC, idx) AS r
 FROM se WHERE bundle IS NULL AND (bid_id, line_no) IN (SELECT (bid_id, line_no) FROM opt WHERE bundle IS NOT NULL)),
s AS (SELECT bid_id, line_no, 0 AS k, 'Recommended' AS label, price, bundle FROM opt UNION ALL SELECT bid_id, line_no, 1, 'Match best competitor', round(best_price, 2), NULL FROM opt
 UNION ALL SELECT bid_id, line_no, 2, 'Standard price', standard_price, NULL FROM opt UNION ALL SELECT bid_id, line_no, 3, 'Margin floor', floor_price, NULL FROM opt
 UNION ALL SELECT bid_id, line_no, 4, 'Best price without a bundle', price, NULL FROM nb WHERE r = 1)
SELECT label, count(*) AS n FROM (SELECT CASE WHEN max(k) = 4 THEN 'Best price without a bundle' ELSE arg_min(label, k) END AS label FROM s GROUP BY bid_id, line_no, price, bundle) GROUP BY 1""")
def q_scenarios(spark, d):
    return pricing.price_scenarios(_optimised(spark, d), policy=Policy()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("no_market_price", f"WITH {cte('lines', 'products', 'observations')}, {TIER_SQL} SELECT bid_id, line_no, standard_price AS price, 0.5::DOUBLE AS win_probability FROM cl WHERE sku NOT IN (SELECT mpn FROM observations WHERE observed_on BETWEEN DATE '1999-06-01' - 180 AND DATE '1999-06-01')")
def q_no_market(spark, d):
    offers = market.fresh_observations(bound(spark, d, "observations"), bound(spark, d, "products"), F.lit("1999-06-01").cast("date")).select("mpn")
    return pricing.no_market_price(_costed(spark, d).drop("mpn"), offers).select("bid_id", "line_no", "price", "win_probability")


@query("key_lines", f"""WITH {_TABLES}, {PRICED_SQL}, r AS (SELECT bid_id, line_no, row_number() OVER (PARTITION BY bid_id ORDER BY CAST(stock_ok AS INT), round(standard_price * quantity, 4) DESC, line_no) AS rank FROM base) SELECT bid_id, line_no, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def q_key_lines(spark, d):
    rows = priced_lines(spark, d).withColumn("price", F.round("standard_price", 4)).withColumn("flags", F.array_compact(F.array(F.when(~F.col("stock_ok"), "Backorder"))))
    return pricing.key_lines(rows).select("bid_id", "line_no", "rank")


@query("outcome_deltas", f"""WITH {_TABLES}, {PRICED_SQL} SELECT bid_id, CAST(trunc(median(warranty_months - best_warranty)) AS INT) AS warranty_delta, CAST(trunc(median(lead_time_days - best_lead)) AS INT) AS lead_delta,
round(greatest(0.6, least(1.6, sum(standard_price * quantity) / sum(best_price * quantity))), 6) AS price_ratio FROM base GROUP BY 1""")
def q_deltas(spark, d):
    rows = priced_lines(spark, d).withColumn("price", F.col("standard_price")).withColumn("bundle", F.lit(None).cast("string"))
    return ledger.outcome_deltas(rows).select("bid_id", "warranty_delta", "lead_delta", F.round("price_ratio", 6).alias("price_ratio"))


@query("learning_status", f"WITH {cte('deals')} SELECT 'labels' AS kind, segment AS name, count(*) AS n FROM deals GROUP BY 2 UNION ALL SELECT 'outcomes', CASE WHEN won THEN 'won' ELSE 'lost' END, count(*) FROM deals GROUP BY 2")
def q_learning(spark, d):
    deals = bound(spark, d, "deals")
    return ledger.learning_status(deals.select(F.col("segment").alias("model")), deals.select(F.when(F.col("won"), "won").otherwise("lost").alias("result")))


@query("merge_labels", f"""WITH {cte('products')}, o AS (SELECT DISTINCT category AS model, name AS text, 'old' AS label FROM products), n AS (SELECT DISTINCT category AS model, name AS text, 'new' AS label FROM products WHERE sku % 3 = 0 AND sku % 6 <> 0 AND brand <> 'Brand#11')
SELECT label, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.model = o.model AND n.text = o.text)) GROUP BY 1""")
def q_merge_labels(spark, d):
    p = bound(spark, d, "products")
    old = p.select(F.col("category").alias("model"), F.col("name").alias("text"), F.lit("old").alias("label"), F.lit(0).alias("recorded_at")).distinct()
    new = p.where("sku % 3 = 0 AND brand <> 'Brand#11'").select(
        F.col("category").alias("model"), F.concat(F.lit(" "), F.col("name"), F.lit("  ")).alias("text"), F.lit("new").alias("label"), F.when(F.col("sku") % 6 == 0, "new").alias("predicted"), F.lit(1).alias("recorded_at"))
    return ledger.merge_labels(old, new).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_observations", """SELECT CASE WHEN l_quantity < 5 THEN 'no date' WHEN l_quantity < 8 THEN 'no price' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1""")
def q_ingest(spark, d):
    s = table(spark, d, "supplier")
    raw = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.when(F.col("l_quantity") >= 5, F.to_date("l_shipdate")).alias("observed_on"), F.col("s_name").alias("competitor"), F.lit(None).cast("string").alias("competitor_id"),
        F.when((F.col("l_quantity") < 5) | (F.col("l_quantity") >= 8), F.col("l_extendedprice")).alias("unit_price"), F.col("l_partkey").cast("string").alias("product"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("int").alias("quantity"))
    products = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mpn"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"))
    good, bad = market.ingest_observations(raw, "quotes", products, s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")), s.where("s_suppkey % 10 = 3").select(F.col("s_name").alias("name")))
    return good.select(F.lit("kept").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("tiers_by_category", f"WITH {values(TIERS, 'category, min_qty, discount_pct', 'tiers')}, {cte('products')} SELECT p.sku, string_agg(t.min_qty || ':' || CAST(t.discount_pct AS INT), ',' ORDER BY t.min_qty) AS steps FROM products p JOIN tiers t ON t.category = p.category GROUP BY 1")
def q_tiers(spark, d):
    steps = tender.tiers_by_category(tiers(spark))
    joined = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["min_qty"].cast("string"), s["discount_pct"].cast("int").cast("string"))), ",")
    return bound(spark, d, "products").join(steps, "category").select("sku", joined.alias("steps"))


@query("scalar_functions", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS big, CASE WHEN l_quantity * 5 >= 200 THEN 6.0 WHEN l_quantity * 5 >= 100 THEN 4.5 WHEN l_quantity * 5 >= 50 THEN 3.0 WHEN l_quantity * 5 >= 20 THEN 1.5 ELSE 0.0 END AS volume,
greatest(0.6, least(2.0, l_quantity / 20)) AS clamped, round(l_extendedprice / (l_extendedprice + 6), 9) AS saturated FROM lineitem""")
def q_scalars(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (q >= 40).cast("int").alias("big"), scalars.volume_discount(q * 5).alias("volume"), scalars.clamp(q / 20, 0.6, 2.0).alias("clamped"), F.round(scalars.saturate(F.col("l_extendedprice")), 9).alias("saturated"))


@query("parse_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS DOUBLE) WHEN o_orderkey % 4 = 1 THEN o_orderkey * 100000.0 WHEN o_orderkey % 4 = 2 THEN o_orderkey * 10000000.0 END AS amount FROM orders")
def q_parse_amount(spark, d):
    k = F.col("o_orderkey")
    written = F.when(k % 4 == 0, F.concat(F.lit("Rs. "), F.format_number(k, 0), F.lit("/Nos"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(" lakh"))).when(k % 4 == 2, F.concat(F.lit("₹"), k.cast("string"), F.lit(" crore"))).otherwise(F.lit("n/a"))
    return table(spark, d, "orders").select("o_orderkey", scalars.parse_amount(written).alias("amount"))


@query("set_algebra", """WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(list(l_suppkey % 10))) AS s, list_sort(list_distinct(list(l_partkey % 10))) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k, len(list_intersect(s, p))::INT AS both, len(list_filter(s, lambda x: NOT list_contains(p, x)))::INT AS only_s, round(len(list_intersect(s, p))::DOUBLE / len(list_distinct(list_concat(s, p))), 9) AS jaccard FROM a""")
def q_sets(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("s"), F.collect_set(F.col("l_partkey") % 10).alias("p"))
    return rows.select("k", F.size(F.array_intersect("s", "p")).alias("both"), F.size(F.array_except("s", "p")).alias("only_s"), F.round(scalars.jaccard(F.col("s"), F.col("p")), 9).alias("jaccard"))


@query("fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents")
def q_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("digest"))


@query("ngrams", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, md5(array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ')) AS digest FROM t")
def q_ngrams(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(text.ngrams(F.split("text", " ")), " ")).alias("digest"))


@query("lift_to_floor", f"WITH {_TABLES}, {PRICED_SQL} SELECT bid_id, line_no, CASE WHEN best_price < floor_price + 5 THEN greatest(round(best_price, 4), ceil(floor_price + 5)) ELSE round(best_price, 4) END AS unit_price FROM base")
def q_lift(spark, d):
    rows = priced_lines(spark, d).withColumn("unit_price", F.col("best_price")).withColumn("bundle_cost", F.lit(5.0))
    return costing.lift_to_floor(rows).select("bid_id", "line_no", F.round("unit_price", 4).alias("unit_price"))


@query("stream_intake_batch", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_intake_batch(spark, d):
    from bidframe.streaming.queries import intake_counts

    return intake_counts(table(spark, d, "events"))


@query("sessions", """WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS bid_id, min(ts) AS started_at, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM g GROUP BY user_id, k""")
def q_sessions(spark, d):
    from bidframe.streaming.queries import turnaround

    runs = table(spark, d, "events").select(F.col("user_id").alias("bid_id"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    return turnaround(runs, "6 hours").select("bid_id", "started_at", "seconds")


@query("page_prices")
def q_page_prices(spark, d):
    from bidframe.sources.tabular import extract_page_prices

    return extract_page_prices(table(spark, d, "pages"))


@query("status_by_segment", f"WITH {cte('bids')} SELECT segment, status, count(*) AS n FROM bids GROUP BY 1, 2")
def q_status_segment(spark, d):
    bids = bound(spark, d, "bids")
    parts = [monitor.status_counts(bids.where(F.col("segment") == s)).where("status <> 'total'").withColumn("segment", F.lit(s)) for s in ("enterprise", "smb", "public", "education", "healthcare")]
    return market.union_sources(*parts)
