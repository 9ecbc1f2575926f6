"""Registered queries of readers over written files, item alignment, what-if prices and the choice of exchange rates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidframe.operators import compliance, finance, pricing
from bidframe.plans.bindings import priced_lines, table
from bidframe.plans.queries import _TABLES, PRICED_SQL, _p_sql, query
from bidframe.plans.rule_queries import _pick
from bidframe.sources import tabular
from bidframe.sources.scratch import folder, stored


def _path(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(lines, path: str) -> None:
    """One text file a brand, its lines in the order of ``k``."""
    lines.repartition("p_brand").sortWithinPartitions("p_brand", "k").drop("k").write.partitionBy("p_brand").text(path)


# ---- readers

@query("map_headers", "SELECT p_partkey AS sku, p_name AS name, p_retailprice AS cost, CAST(NULL AS VARCHAR) AS tax FROM part")
def q_map_headers(spark, d):
    """Columns are found by equal names first, then by contained words; a field without a column is null."""
    path = _path(spark, "headed")
    rows = table(spark, d, "part").select(F.col("p_name").alias("Item Description"), F.col("p_retailprice").alias("Unit  Cost (net)"), F.col("p_partkey").alias("SKU"))
    rows.repartition(3).write.option("header", True).option("sep", ";").csv(path)
    back = tabular.read_delimited(spark, path)
    got = tabular.map_headers(back, stored(tabular.detect_header(back), "heads").hint("merge"), {"sku": ["code", "sku"], "name": ["description"], "cost": ["unit cost"], "tax": ["tax rate"]})
    return got.select(F.col("sku").cast("long").alias("sku"), "name", F.col("cost").cast("double").alias("cost"), "tax")


@query("read_stock_xml", "SELECT p_partkey AS sku, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_size || ' Nos' END AS stock, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 * 9 END AS DOUBLE) AS gst_rate_pct FROM part")
def q_stock_xml(spark, d):
    """Stock items written as an export; the integrated tax counts and its place may be empty."""
    path = _path(spark, "stock")
    n = F.col("p_partkey").cast("string")
    rate = lambda head, value: F.concat(F.lit(f"<RATEDETAILS><GSTRATEDUTYHEAD>{head}</GSTRATEDUTYHEAD><GSTRATE>"), value, F.lit("</GSTRATE></RATEDETAILS>"))
    pct = F.col("p_partkey") % 3 * 9
    taxes = F.concat(rate("Central Tax", F.lit("4")), F.when(pct > 0, rate("Integrated Tax", pct.cast("string"))).otherwise(""))
    stock = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<OPENINGBALANCE>"), F.col("p_size").cast("string"), F.lit(" Nos</OPENINGBALANCE>"))).otherwise("")
    item = F.concat(F.lit('<STOCKITEM NAME="'), F.col("p_name"), F.lit('"><HSNCODE>'), n, F.lit("</HSNCODE>"), stock, F.lit("<GSTDETAILS.LIST>"), taxes, F.lit("</GSTDETAILS.LIST></STOCKITEM>"))
    parts = table(spark, d, "part")
    around = parts.select("p_brand").distinct().select("p_brand", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.lit("<ENVELOPE>").alias("value")), F.struct(F.lit(2).alias("k"), F.lit("</ENVELOPE>").alias("value")))))
    _files(around.unionByName(parts.select("p_brand", F.lit(1).alias("k"), item.alias("value"))), path)
    return tabular.read_stock_xml(spark, path).select(F.col("hsn").cast("long").alias("sku"), "name", "stock", "gst_rate_pct")


@query("read_markdown_sections", "SELECT p_brand AS title, p_name AS heading, 'Size ' || p_size AS body, count(*) AS n FROM part GROUP BY 1, 2, 3")
def q_markdown(spark, d):
    """One file a brand with a title and a section for each part."""
    path = _path(spark, "guide")
    parts = table(spark, d, "part")
    section = F.concat(F.lit("## "), F.col("p_name"), F.lit("\nSize "), F.col("p_size").cast("string"), F.lit("\n"))
    title = parts.select("p_brand").distinct().select("p_brand", F.lit(0).alias("k"), F.concat(F.lit("# "), F.col("p_brand")).alias("value"))
    _files(title.unionByName(parts.select("p_brand", F.lit(1).alias("k"), section.alias("value"))), path)
    return tabular.read_markdown_sections(spark, path).groupBy("title", "heading", "body").agg(F.count(F.lit(1)).alias("n"))


@query("read_text_documents", "SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def q_text_documents(spark, d):
    """Names written to text files of at most a thousand lines and read back whole."""
    path = _path(spark, "texts")
    table(spark, d, "part").select(F.col("p_name").alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    lines = tabular.read_text_documents(spark, path).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("read_reference_json", "SELECT p_partkey AS id, p_name AS name, p_size % 5 AS places FROM part")
def q_reference_json(spark, d):
    """Files of about a thousand records each, written over several lines; a missing list is read as null."""
    path = _path(spark, "reference")
    record = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 > 0, F.array_repeat("p_brand", F.col("p_size") % 5)).alias("places"))
    files = table(spark, d, "part").groupBy(F.expr("p_partkey div 1000").alias("file")).agg(F.to_json(F.collect_list(record), {"pretty": "true"}).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    back = tabular.read_reference_json(spark, f"{path}/*/*.txt", "id bigint, name string, places array<string>")
    return back.select("id", "name", F.coalesce(F.size("places"), F.lit(0)).cast("int").alias("places"))


@query("load_if_empty", "SELECT p_brand AS brand, count(*) AS n, false AS on_rows, true AS on_empty, false AS again FROM part GROUP BY 1 UNION ALL SELECT 'sizes', CAST(count(DISTINCT p_size) AS BIGINT), false, true, false FROM part")
def q_load_if_empty(spark, d):
    """A table with rows is left alone, an empty one is loaded, once."""
    sizes, brands = f"sizes_{uuid.uuid4().hex}", f"brands_{uuid.uuid4().hex}"
    parts = table(spark, d, "part")
    tabular.load_if_empty(parts.select("p_size").distinct(), sizes, _path(spark, "sizes"))
    on_rows = tabular.load_if_empty(parts.select("p_size").where("p_size < 0"), sizes)
    path = _path(spark, "brands")
    tabular.load_if_empty(parts.select("p_brand").where("p_brand IS NULL"), brands, path)
    on_empty = tabular.load_if_empty(parts.select("p_brand"), brands, path)
    again = tabular.load_if_empty(parts.select("p_brand").distinct(), brands, path)
    found = spark.table(brands).groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(spark.table(sizes).agg(F.lit("sizes").alias("brand"), F.count(F.lit(1)).alias("n")))
    return found.withColumns({"on_rows": F.lit(on_rows), "on_empty": F.lit(on_empty), "again": F.lit(again)})


@query("read_tiers", "SELECT DISTINCT p_brand AS category, CAST(p_size AS INT) AS min_qty, p_size / 4.0::DOUBLE AS discount_pct FROM part")
def q_tiers(spark, d):
    """One JSON file a brand; its steps are its distinct sizes."""
    path = _path(spark, "tiers")
    steps = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set(F.struct(F.col("p_size").cast("int").alias("min_qty"), (F.col("p_size") / 4.0).alias("discount_pct")))).alias("steps"))
    steps.select("brand", F.to_json(F.create_map("brand", "steps")).alias("value")).write.partitionBy("brand").text(path)
    return tabular.read_tiers(spark, path)


@query("page_prices_composed", """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN NULL ELSE 'Page of ' || p_name END AS name, CASE WHEN p_partkey % 4 < 3 THEN p_size * 1000 + 0.5 END::DOUBLE AS price,
CASE WHEN p_partkey % 4 = 0 THEN 'USD' ELSE 'INR' END AS currency, CASE p_partkey % 4 WHEN 0 THEN 'schema.org offer' WHEN 1 THEN 'price meta tag' WHEN 2 THEN 'visible text' END AS source FROM part""")
def q_page_prices(spark, d):
    k, size, name = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_name")
    around = lambda before, middle, after: F.concat(F.lit(before), middle, F.lit(after))
    title, visible = around("<html><title>Page of ", name, "</title>"), around("<p>now <b>Rs. ", size, ",000.5</b></p>")
    offer = F.concat(around('<script type="application/ld+json">{"name":"', name, '","offers":{"priceCurrency":"USD","price":"'), size, F.lit('000.5"}}</script>'))
    meta = around('<meta property="og:price:amount" content="', size, ',000.5">')
    html = F.when(k == 0, F.concat(title, offer, meta, visible)).when(k == 1, F.concat(title, meta, visible)).when(k == 2, F.concat(title, visible)).otherwise("<html>nothing")
    return tabular.extract_page_prices(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


# ---- alignment of item lists

_ITEMS = [  # first reading: line, words, quantity; k is the part, n its size
    (1, ("w{k} cable red", "n")), (2, ("w{k} cable", "n")), (3, ("z{k} printer", "n + 1")), (4, ("q{k} scanner", "n + 9"))]
_ITEMS_2 = [(1, ("w{k} cable", "n")), (2, ("w{k} cable red", "n + k % 2")), (3, ("z{k} printer mono", "n + 1 + least(k % 3, 1)")), (4, ("projector", "n + 9"))]


def _items(spark, d, items):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("n"))
    one = lambda no, words, quantity: F.struct(F.lit(no).alias("line_no"), F.replace(F.lit(words), F.lit("{k}"), F.col("k").cast("string")).alias("description"), F.expr(quantity).cast("int").alias("quantity"))
    return rows.select(F.col("k").alias("doc_id"), F.inline(F.array(*(one(no, *rest) for no, rest in items))))


@query("align_items", """SELECT p_partkey AS doc_id, CAST(unnest(CASE WHEN p_partkey % 2 = 0 THEN [1, 2] ELSE [1] END || CASE WHEN p_partkey % 3 = 0 THEN [3] ELSE [] END) AS INT) AS left_no,
CAST(unnest(CASE WHEN p_partkey % 2 = 0 THEN [2, 1] ELSE [1] END || CASE WHEN p_partkey % 3 = 0 THEN [3] ELSE [] END) AS INT) AS right_no, unnest(CASE WHEN p_partkey % 2 = 0 THEN [1.0, 1.0] ELSE [0.666667] END || CASE WHEN p_partkey % 3 = 0 THEN [0.666667] ELSE [] END)::DOUBLE AS score FROM part""")
def q_align(spark, d):
    """The first line takes the best line of its quantity; the second has to do with what is left."""
    gold, parsed = stored(_items(spark, d, _ITEMS), "gold"), stored(_items(spark, d, _ITEMS_2), "parsed")
    return compliance.align_items(gold, parsed).withColumn("score", F.round("score", 6))


@query("reconcile_items", """SELECT p_partkey AS doc_id, unnest([1, 2, 3, 4, NULL])::INT AS left_no, unnest([2, 1, 3, NULL, 4])::INT AS right_no,
unnest([CASE WHEN p_partkey % 2 = 0 THEN 'agreed' ELSE 'quantity change' END, 'agreed', CASE WHEN p_partkey % 3 = 0 THEN 'agreed' ELSE 'quantity change' END, 'only first', 'only second']) AS outcome FROM part""")
def q_reconcile(spark, d):
    gold, parsed = stored(_items(spark, d, _ITEMS), "gold"), stored(_items(spark, d, _ITEMS_2), "parsed")
    return compliance.reconcile_items(gold, parsed)


# ---- what-if prices

_WARRANTY = "CASE WHEN award = 'L1' THEN 0 ELSE warranty_months - best_warranty END"
_LEAD = "CASE WHEN award = 'L1' THEN 0 ELSE lead_time_days - best_lead END"


@query("assess_prices", f"""WITH {_TABLES}, {PRICED_SQL}, w AS (SELECT *, unnest(['below', 'match', 'dear']) AS kind, unnest([floor_price * 0.98, best_price, standard_price]) AS price, unnest([NULL, 'B', 'B']) AS bundle, unnest([0.0, 0.04, 0.08]) AS share FROM base),
v AS (SELECT *, price * share AS bundle_cost FROM w), p AS (SELECT *, {_p_sql("1 + (price / best_price - 1) * greatest(0.6, least(2.0, price_weight / 50))", _WARRANTY, _LEAD, "(award <> 'L1' AND bundle IS NOT NULL)", "(award <> 'L1' AND repeat_customer)")} AS p,
price < floor_price - 1e-6 AS low, bundle IS NOT NULL AND price - bundle_cost < floor_price - 1e-6 AS unfunded, bundle IS NOT NULL AND bundle_cost > price * 6.0 / 100 AS large FROM v)
SELECT bid_id, line_no, kind, round(p, 6) AS win_probability, NOT (low OR unfunded OR large) AS feasible, CAST(low AS INT) + CAST(unfunded AS INT) + CAST(large AS INT) AS issues, round(100 * (price - unit_cost - bundle_cost) / price, 6) AS margin_pct, round(100 * (price / best_price - 1), 6) AS vs_best_pct FROM p""")
def q_assess(spark, d):
    """Three proposals a line: below the floor, the rival's price with a bundle, the standard price with too large a bundle."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), price.alias("price"), F.lit(b).cast("string").alias("bundle"), F.lit(share).alias("share")) for k, price, b, share in [
        ("below", F.col("floor_price") * 0.98, None, 0.0), ("match", F.col("best_price"), "B", 0.04), ("dear", F.col("standard_price"), "B", 0.08)]))
    lines = priced_lines(spark, d)
    rows = lines.select("*", F.inline(kinds)).withColumn("bundle_cost", F.col("price") * F.col("share")).withColumn("bundle_months", F.lit(0))
    out = pricing.assess_prices(rows)
    rounded = lambda c: F.round(c, 6).alias(c)
    return out.select("bid_id", "line_no", "kind", rounded("win_probability"), "feasible", F.size("issues").alias("issues"), rounded("margin_pct"), rounded("vs_best_pct"))


@query("fx_table", """WITH c AS (SELECT o_custkey AS base, ['live', 'cache', 'reference'][o_orderkey % 3 + 1] AS source, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 80000 AS INT)) AS fetched_at, o_orderkey % 20 AS n FROM orders),
r AS (SELECT *, CASE WHEN source = 'cache' AND fetched_at >= TIMESTAMP '1998-01-02' - INTERVAL 360 DAY THEN 1 WHEN source = 'live' AND n >= 10 THEN 2 WHEN source = 'cache' THEN 3 WHEN source = 'reference' THEN 4 END AS k FROM c)
SELECT base, source, strftime(fetched_at, '%Y-%m-%d') AS day, k >= 3 AS stale FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k, fetched_at DESC) AS i FROM r WHERE k IS NOT NULL) WHERE i = 1""")
def q_fx_table(spark, d):
    """The orders of a customer stand for the fetches of a base's rates; a live one with fewer than ten rates is no choice."""
    k = F.col("o_orderkey")
    at = F.to_timestamp(F.to_date("o_orderdate")) + F.make_dt_interval(secs=k % 80000)
    rates = F.map_from_entries(F.transform(F.array_repeat(F.lit(1.0), (k % 20).cast("int")), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v"))))
    candidates = table(spark, d, "orders").select(F.col("o_custkey").alias("base"), _pick(k, ("live", "cache", "reference")).alias("source"), at.alias("fetched_at"), rates.alias("rates"))
    chosen = finance.fx_table(candidates, 360 * 86400, F.lit("1998-01-02").cast("timestamp"))
    return chosen.select("base", "source", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), "stale")
