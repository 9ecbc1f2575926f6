"""Registered queries of extraction, evidence, imports and proposals; texts are composed from columns, the SQL states what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import compliance, corpus, costing, ledger, pricing, retrieval, tender
from bidframe.plans.bindings import bound, cte, spread, table
from bidframe.plans.queries import _TABLES, GRID_SQL, PRICED_SQL, _optimised, query
from bidframe.plans.rule_queries import _pick, _pick_sql
from bidframe.sources import imports


def _text(spark, d, *parts):
    """A document of each product: the parts, strings or columns, in a row."""
    said = F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    return spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), said.alias("text"), "p_size", "p_name")


def _size():
    return F.col("p_size").cast("string")


@query("labelled_values", "SELECT p_partkey AS doc_id, p_name AS client, p_brand AS reference, CAST(NULL AS VARCHAR) AS title FROM part")
def q_labelled(spark, d):
    docs = _text(spark, d, "Tender\nBuyer : ", F.col("p_name"), "\nTender No: ", F.col("p_brand"), "\nBuyer: other\n")
    return corpus.labelled_values(docs, {"client": "client|buyer", "reference": r"tender no\.?|reference", "title": "subject|title"})


@query("extract_client", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' University' END AS client FROM part")
def q_client(spark, d):
    even = F.col("p_partkey") % 2 == 0
    docs = _text(spark, d, "Notice\n", F.when(even, F.concat(F.lit("Acme Ltd\nClient: "), F.col("p_name"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" University "))), "\nend")
    return corpus.extract_client(docs)


@query("find_dates", "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders, (VALUES (1), (2), (3), (4)) v(i) GROUP BY 1, 2")
def q_find_dates(spark, d):
    at = lambda f: F.date_format("o_orderdate", f)
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Due "), at("yyyy-MM-dd"), F.lit(" or "), at("d MMM yyyy"), F.lit(", that is "), at("MMMM d, yyyy"), F.lit(" ("), at("dd/MM/yyyy"), F.lit("), not 45/45/2020.")).alias("text"))
    return corpus.find_dates(docs).groupBy("doc_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("date_roles", "SELECT o_orderkey AS doc_id, unnest(['issued', 'due']) AS role, unnest([CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 30]) AS date FROM orders")
def q_date_roles(spark, d):
    at = lambda days: F.date_format(F.date_add("o_orderdate", days), "dd/MM/yyyy")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Dated "), at(0), F.lit("\nPlace\nLast date of submission: "), at(30), F.lit("\nDeadline was "), at(60)).alias("text"))
    return corpus.date_roles(corpus.date_contexts(docs)).select("doc_id", "role", "date")


@query("extract_currency", f"SELECT o_custkey AS doc_id, arg_min({_pick_sql('o_orderkey', ('USD', 'EUR', 'INR', 'SGD'))}, o_orderkey) AS currency FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def q_currency(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.lit("SG").alias("country"),
                                            F.concat(F.when(F.col("o_orderkey") % 3 > 0, "Quoted prices in ").otherwise("We like "), _pick(F.col("o_orderkey"), ("US dollars", "euros", "Rupees", "$"))).alias("sentence"))
    return tender.extract_currency(rows)


@query("resolve_location", "WITH m AS (SELECT o_custkey AS doc_id, o_orderpriority AS country, max(CAST(o_orderstatus = 'P' AS INT)) AS a, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT c_custkey AS doc_id, b.country FROM customer LEFT JOIN (SELECT doc_id, arg_max(country, (a, n, -f)) AS country FROM m GROUP BY 1) b ON b.doc_id = c_custkey")
def q_location(spark, d):
    mentions = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("country"), F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "P").alias("on_address"))
    return tender.resolve_location(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), mentions)


@query("find_places", "SELECT p_partkey AS doc_id, n_name AS place, count(*) AS n FROM part JOIN nation ON n_nationkey = p_size % 25 GROUP BY 1, 2")
def q_places(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("land of "), F.lower(F.regexp_replace("n_name", "_", ""))).alias("alias"), F.col("n_name").alias("place"))
    inner = table(spark, d, "nation").select(F.lower(F.regexp_replace("n_name", "_", "")).alias("alias"), F.concat(F.lit("inside "), F.col("n_name")).alias("place"))
    docs = _text(spark, d, "Goods for the Land of Nation", (F.col("p_size") % 25).cast("string"), ", by ship")
    return corpus.find_places(docs, names.unionByName(inner)).groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n"))


@query("extract_terms", "SELECT p_partkey AS doc_id, 'CIF' AS incoterm, CAST(7 * p_size AS INT) AS delivery_days, CAST(p_size AS INT) AS payment_days, CAST(p_size % 40 AS INT) AS advance_pct, 36 AS warranty_months, CAST(p_size AS INT) AS price_weight_pct, true AS lowest_price FROM part")
def q_terms(spark, d):
    docs = _text(spark, d, "Terms are CIF. Delivery is due within ", _size(), " weeks. Payment net ", _size(), " days.\n", (F.col("p_size") % 40).cast("string"), "% advance. A warranty of three years.\nPrice weight: ", _size(), " %. The lowest bid wins.")
    return corpus.extract_terms(docs)


@query("extract_line_items", "SELECT p_partkey AS doc_id, CAST(i AS INT) AS line_no, CAST(CASE i WHEN 1 THEN p_size WHEN 2 THEN 2 * p_size WHEN 3 THEN 12 END AS INT) AS quantity FROM part, (VALUES (1), (2), (3)) v(i) WHERE p_size > 0")
def q_items(spark, d):
    docs = _text(spark, d, "We ask for offers.\n- ", _size(), " x laptops with 16 GB RAM\n- Monitors, qty: ", (2 * F.col("p_size")).cast("string"), "\n- twelve office chairs\n- RFQ No. 12\n").where("p_size > 0")
    return corpus.extract_line_items(docs).select("doc_id", "line_no", "quantity")


@query("extract_table_items", "SELECT p_partkey AS doc_id, i AS pos, CASE i WHEN 2 THEN p_name ELSE p_brand END AS description, CAST(CASE i WHEN 2 THEN p_size ELSE 1000 + p_size END AS INT) AS quantity FROM part, (VALUES (2), (3)) v(i)")
def q_table_items(spark, d):
    lines = F.array(F.lit("intro"), F.lit("| Sl | Item description | Qty |"), F.concat(F.lit("| 1 | "), F.col("p_name"), F.lit(" | "), _size(), F.lit(" Nos |")), F.concat(F.lit("| 2 | "), F.col("p_brand"), F.lit(" | "), F.format_number(1000 + F.col("p_size"), 0), F.lit(" |")), F.lit("| | Total | see above |"), F.lit("| 3 | Ghost | 4 |"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(lines).alias("pos", "line"))
    return tender.extract_table_items(rows).select("doc_id", "pos", "description", "quantity")


@query("extract_specs", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS INT) AS ram_gb, CAST(CASE WHEN p_partkey % 2 = 1 THEN p_size END AS INT) AS vram_gb, CAST(1000 * p_size AS INT) AS storage_gb, p_size + 0.5 AS screen_inch, CAST(p_size AS INT) AS ports, true AS poe, CAST(1000 * p_size AS INT) AS va FROM part")
def q_specs(spark, d):
    said = F.concat(F.when(F.col("p_partkey") % 2 == 1, "Graphics card ").otherwise("Desktop "), _size(), F.lit(" GB RAM, "), _size(), F.lit(" TB SSD, "), _size(), F.lit(".5 inch, "), _size(), F.lit("-port PoE, "), _size(), F.lit(" kVA"))
    return table(spark, d, "part").select("p_partkey", corpus.extract_specs(said).alias("s")).select("p_partkey", "s.ram_gb", "s.vram_gb", "s.storage_gb", "s.screen_inch", "s.ports", "s.poe", "s.va")


@query("route_clauses", f"""WITH u AS (SELECT l_quantity > 20 AS q, (l_partkey % 10) / 10.0 AS item, (l_suppkey % 10) / 10.0 AS conf, (l_orderkey % 10) / 10.0 AS cat, {_pick_sql('l_linenumber', ('payment', 'delivery'))} AS label FROM lineitem)
SELECT CASE WHEN q AND (item >= 0.4 OR (item >= 0.2 AND cat >= 0.7)) THEN 'line_item' WHEN conf < 0.45 THEN 'scope' ELSE label END AS route, count(*) AS n FROM u GROUP BY 1""")
def q_route(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") > 20).alias("has_quantity"), ((F.col("l_partkey") % 10) / 10).alias("p_item"), ((F.col("l_suppkey") % 10) / 10).alias("confidence"), ((F.col("l_orderkey") % 10) / 10).alias("category_confidence"), _pick(F.col("l_linenumber"), ("payment", "delivery")).alias("label"))
    return compliance.route_clauses(rows).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("type_sections", f"SELECT o_custkey AS doc_id, o_orderkey AS section, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_pick_sql('o_orderkey // 3', ('delivery', 'warranty'))} END AS kind FROM orders")
def q_type_sections(spark, d):
    k = F.floor(F.col("o_orderkey") / 3)
    word = F.when(F.col("o_orderkey") % 3 > 0, _pick(k, ("Delivery", "Warranty"))).otherwise("Notes")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), F.when(F.col("o_orderkey") % 3 == 1, word).otherwise("Page").alias("title"), F.when(F.col("o_orderkey") % 3 == 2, F.concat_ws(" ", word, word, word, word)).otherwise(word).alias("body"))
    rows = rows.withColumn("body", F.when(F.col("section") % 3 == 0, "nothing").otherwise(F.col("body")))
    lexicon = table(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "delivery").otherwise("warranty").alias("kind"), F.when(F.col("r_regionkey") == 0, "delivery").otherwise("warranty").alias("word"), F.lit(2.0).alias("weight"))
    return tender.type_sections(rows, lexicon).select("doc_id", "section", "kind")


@query("link_specs", f"WITH {cte('lines')} SELECT bid_id AS doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN '5.' || ((line_no - 1) % 2 + 1) ELSE '5.1' END AS number FROM lines WHERE line_no % 2 = 0 OR sku % 2 = 0")
def q_link_specs(spark, d):
    rows = bound(spark, d, "lines")
    lines = rows.select(F.col("bid_id").alias("doc_id"), "line_no", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("Item as per specification 5."), ((F.col("line_no") - 1) % 2 + 1).cast("string"))).when(F.col("sku") % 2 == 0, "portable computer").otherwise("chair").alias("description"), F.lit("x").alias("category"))
    specs = rows.select(F.col("bid_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.struct(F.lit("5.1").alias("number"), F.lit("Portable computer").alias("title")), F.struct(F.lit("5.2").alias("number"), F.lit("Monitor").alias("title")))).alias("s")).select("doc_id", "s.*", F.lit("y").alias("category"))
    return tender.link_specs(lines, specs)


@query("scope_text", "SELECT o_custkey AS doc_id, md5(string_agg('t' || o_orderkey, chr(10) ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END, o_orderkey)) AS digest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def q_scope_text(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("text"))
    return tender.scope_text(rows, {"F": 1, "O": 2}).select("doc_id", F.md5("text").alias("digest"))


# ---- sections and tables

_HEADS = "CASE WHEN l_partkey % 4 = 0 THEN 1 + l_suppkey % 2 END"


@query("section_owner", f"""WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, {_HEADS} AS level FROM lineitem)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(max(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS owner FROM b""")
def q_owner(spark, d):
    return corpus.section_owner(_blocks(spark, d)).select("doc_id", "pos", "owner")


def _blocks(spark, d):
    rows = bound(spark, d, "lines")
    return rows.select(F.col("bid_id").alias("doc_id"), F.col("line_no").alias("pos"), F.when(F.col("sku") % 4 == 0, 1 + F.col("supplier_id") % 2).cast("int").alias("level"), F.lit("t").alias("title"))


_PATHS = f"""b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, {_HEADS} AS level FROM lineitem),
h AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS top, max(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS owner FROM b)"""


@query("section_paths", f"WITH {_PATHS} SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN level = 1 OR top IS NULL THEN CAST(pos AS VARCHAR) ELSE top || '/' || pos END AS path FROM h WHERE level IS NOT NULL")
def q_paths(spark, d):
    return corpus.section_paths(_blocks(spark, d)).select("doc_id", "pos", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("section_rollup", f"WITH {_PATHS}, i AS (SELECT h.doc_id, o.pos AS own, CASE WHEN o.level = 2 THEN o.top END AS up FROM h JOIN h o ON o.doc_id = h.doc_id AND o.pos = h.owner WHERE h.level IS NULL), s AS (SELECT doc_id, own AS section FROM i UNION ALL SELECT doc_id, up FROM i WHERE up IS NOT NULL) SELECT doc_id, CAST(section AS INT) AS section, count(*) AS items FROM s GROUP BY 1, 2")
def q_rollup(spark, d):
    blocks = _blocks(spark, d)
    items = corpus.section_owner(blocks).where("level IS NULL").select("doc_id", "owner")
    return corpus.section_rollup(corpus.section_paths(blocks), items)


@query("stitch_tables", """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderstatus AS header FROM orders), n AS (SELECT *, coalesce(header <> lag(header) OVER (PARTITION BY doc_id ORDER BY pos), true) AS new FROM t)
SELECT doc_id, pos, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS table_id FROM n""")
def q_stitch(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("header"))
    return corpus.stitch_tables(rows).select("doc_id", "pos", F.col("table_id").cast("long").alias("table_id"))


# ---- evidence and matches

@query("evidence", """WITH s AS (SELECT l_suppkey AS q, l_partkey AS sec, l_orderkey * 10 + l_linenumber AS sid, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, sid) AS n FROM s),
c AS (SELECT l_suppkey AS q, l_partkey AS sec, max(l_tax) AS score FROM lineitem GROUP BY 1, 2) SELECT t.q AS query_id, t.sid AS sentence_id, t.sec AS section_id, round(0.55 * c.score + 0.45 * t.score, 6) AS score FROM t JOIN c ON c.q = t.q AND c.sec = t.sec WHERE n <= 60 AND c.score >= 0.03""")
def q_evidence(spark, d):
    rows = table(spark, d, "lineitem")
    key = [F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("section_id")]
    sections = rows.groupBy(*key).agg(F.max("l_tax").alias("score"))
    sentences = rows.groupBy(*key, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_id")).agg(F.max("l_discount").alias("score"))
    return tender.evidence(sections, sentences, 0.03).select("query_id", "sentence_id", "section_id", F.round("score", 6).alias("score"))


@query("relevant_evidence", "SELECT p_partkey FROM part WHERE p_partkey % 10 >= 4 AND p_partkey % 3 > 0")
def q_relevant(spark, d):
    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 10) / 10).alias("score"), F.lit("laptop battery warranty and supply of equipment").alias("query"),
                                          _pick(F.col("p_partkey"), ("supply of equipment to the bidder", "batteries carry a warranty", "laptop batteries: warranty by the maker")).alias("passage"))
    return tender.relevant_evidence(rows).select("p_partkey")


@query("retrieval_log", "SELECT o_orderpriority AS purpose, o_custkey AS query, count(*) AS n, CAST(arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS VARCHAR) AS best FROM orders GROUP BY 1, 2")
def q_log(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("purpose"), F.col("o_custkey").alias("query"), F.struct("o_totalprice", "o_orderkey").alias("score"), F.col("o_orderkey").cast("string").alias("passage"))
    return tender.retrieval_log(rows).select("purpose", "query", F.size("passages").cast("long").alias("n"), F.get("passages", F.lit(0)).alias("best"))


@query("match_catalogue", f"""WITH h AS (SELECT l_suppkey AS q, l_partkey AS sku, max(l_discount) * 9 AS score, max(l_tax) * 12 AS fit FROM lineitem GROUP BY 1, 2), m AS (SELECT q, sku, round(greatest(0.0, least(1.0, (CASE WHEN sku % 3 = 0 THEN score ELSE 0.6 * score + 0.4 * fit END + CASE WHEN q % 2 = 0 THEN 0.0 WHEN p_brand = 'Brand#' || (q % 5) THEN 0.08 ELSE -0.10 END) * (0.55 + 0.45 * least(1.0, (sku % 7) / 4.0)))), 9) AS match FROM h JOIN part ON p_partkey = sku)
SELECT q AS query_id, sku AS doc_id, match, CAST(row_number() OVER (PARTITION BY q ORDER BY match DESC, sku) AS INT) AS rank FROM m QUALIFY rank <= 4""")
def q_match(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg((F.max("l_discount") * 9).alias("score"), (F.max("l_tax") * 12).alias("fit"))
    h = h.join(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("brand")), "doc_id").withColumn("fit", F.when(F.col("doc_id") % 3 != 0, F.col("fit")))
    h = h.withColumn("brand_asked", F.when(F.col("query_id") % 2 != 0, F.concat(F.lit("BRAND#"), (F.col("query_id") % 5).cast("string")))).withColumn("p_category", (F.col("doc_id") % 7).cast("double")).withColumn("p_top", F.lit(4.0))
    return tender.match_catalogue(h).select("query_id", "doc_id", F.round("match", 9).alias("match"), "rank")


@query("match_status", "SELECT l_orderkey % 10 AS k, CASE WHEN l_discount * 10 < 0.30 THEN 'unmatched' WHEN l_discount * 10 < 0.42 OR l_tax * 10 < 0.5 THEN 'ambiguous' ELSE 'matched' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_status(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy((F.col("l_orderkey") % 10).alias("k"), retrieval.match_status(F.col("l_discount") * 10, F.col("l_tax") * 10).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- imports

_SHEET = """r AS (SELECT p_partkey AS row_no, p_partkey % 10 AS k, p_retailprice AS price, p_size FROM part)"""


def _sheet(spark, d):
    """A row for each product: by SKU, part number or name, a new one, and rows that must be passed over."""
    k = F.col("p_partkey") % 10
    key = F.col("p_partkey").cast("string")
    none = F.lit(None)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_no"), F.when(k < 3, F.concat(F.lit("s"), key)).alias("sku"), F.when(k == 3, F.concat(F.lit("m"), key)).alias("mpn"), F.when(k == 4, F.concat(F.lit(" Name "), key)).when(k.isin(5, 6), F.concat(F.lit("new laptop "), key)).alias("name"),
        none.cast("string").alias("category"), F.when(k == 5, 100.0).when(k == 1, F.col("p_retailprice")).alias("unit_cost"), F.when(k == 2, F.col("p_retailprice") * 1.5).alias("list_price"), none.cast("int").alias("stock_qty"),
        F.when(k == 5, "85.18").alias("hsn"), F.when(k == 5, 17.0).alias("gst_rate_pct"))


def _known(spark, d):
    key = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.concat(F.lit("S"), key).alias("sku"), F.concat(F.lit("M"), key).alias("mpn"), F.concat(F.lit("name "), key).alias("name"), F.lit("laptop").alias("category"), (F.col("p_retailprice") - 1).alias("unit_cost"), F.col("p_retailprice").alias("list_price"), F.lit(5).alias("stock_qty"), F.col("p_partkey").alias("product_no"))


@query("match_existing", f"WITH {_SHEET} SELECT row_no, CASE WHEN k <= 4 THEN 'S' || row_no END AS matched FROM r")
def q_existing(spark, d):
    return imports.match_existing(_sheet(spark, d), _known(spark, d)).select("row_no", "matched")


@query("import_plan", f"""WITH {_SHEET} SELECT row_no, CASE WHEN k IN (1, 2) THEN 'update' WHEN k = 5 THEN 'create' WHEN k IN (0, 3, 4) THEN 'unchanged' ELSE 'skip' END AS action,
CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS changes, CASE k WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 0 END AS issues FROM r""")
def q_plan(spark, d):
    return imports.import_plan(_sheet(spark, d), _known(spark, d)).select("row_no", "action", F.size("changes").alias("changes"), F.size("issues").alias("issues"))


@query("plan_counts", f"WITH {_SHEET} SELECT count(*) FILTER (WHERE k = 5) AS \"create\", count(*) FILTER (WHERE k IN (1, 2)) AS \"update\", count(*) FILTER (WHERE k IN (0, 3, 4)) AS unchanged, count(*) FILTER (WHERE k > 5) AS skip, CAST(sum(CASE k WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 0 END) AS BIGINT) AS issues FROM r")
def q_plan_counts(spark, d):
    return imports.plan_counts(imports.import_plan(_sheet(spark, d), _known(spark, d)))


@query("import_commit", f"WITH {_SHEET}, c AS (SELECT 'S' || row_no AS sku, CASE k WHEN 1 THEN price ELSE price - 1 END AS unit_cost, CASE k WHEN 2 THEN price * 1.5 ELSE price END AS list_price FROM r), n AS (SELECT NULL AS sku, 100.0 AS unit_cost, 115.0 AS list_price FROM r WHERE k = 5), v AS (SELECT * FROM c UNION ALL SELECT * FROM n) SELECT sku IS NULL AS new, count(*) AS n, round(sum(unit_cost), 2) AS cost, round(sum(list_price), 2) AS list, (SELECT count(*) FROM r WHERE k IN (1, 2, 5)) AS versions FROM v GROUP BY 1")
def q_commit(spark, d):
    plan = imports.import_plan(_sheet(spark, d), _known(spark, d))
    catalogue, versions = imports.import_commit(plan, _known(spark, d), F.lit("2026-01-01").cast("timestamp"))
    n = versions.agg(F.count(F.lit(1)).alias("versions"))
    sums = catalogue.groupBy(F.col("sku").isNull().alias("new")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("unit_cost"), 2).alias("cost"), F.round(F.sum("list_price"), 2).alias("list"))
    return sums.join(F.broadcast(n))  # one row


# ---- proposals

@query("apply_review_edits", "SELECT o_orderkey AS bid_id, CASE WHEN o_orderkey % 3 = 0 THEN 'AE' ELSE 'IN' END AS country, CASE WHEN o_orderkey % 3 > 0 THEN 'MH' END AS region, CASE WHEN o_orderkey % 3 > 0 THEN 'Pune' END AS city FROM orders")
def q_edits(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id"))
    bids = o.select("bid_id", F.lit("IN").alias("country"), F.lit("MH").alias("region"), F.lit("Pune").alias("city"))
    edits = o.where("bid_id % 3 < 2").select("bid_id", F.when(F.col("bid_id") % 3 == 0, "AE").otherwise("IN").alias("country"))
    lines = o.select("bid_id", F.lit(1).alias("line_no"), F.lit("parser").alias("origin"))
    return tender.apply_review_edits(bids, edits, lines, lines.limit(0))[0]


@query("bulk_adjust", "SELECT p_partkey, round(p_retailprice * 1.05) AS unit_price, CASE WHEN p_retailprice < 1000.25 THEN 1001.0 ELSE p_retailprice END AS lifted FROM part")
def q_bulk(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("unit_price"))
    lifted = costing.lift_to_floor(rows.withColumn("floor_price", F.lit(1000.0)).withColumn("bundle_cost", F.lit(0.25))).select("p_partkey", F.col("unit_price").alias("lifted"))
    return costing.bulk_adjust(rows, 5.0).join(lifted, "p_partkey")


@query("apply_price_overrides", f"WITH {_TABLES}, {PRICED_SQL}, {GRID_SQL} SELECT bid_id, line_no, CASE WHEN line_no = 1 AND bid_id % 2 = 0 THEN 99.5 ELSE price END AS price, CASE WHEN line_no = 1 AND bid_id % 2 = 0 THEN 'Reviewer override' ELSE strategy END AS strategy FROM opt")
def q_overrides(spark, d):
    priced = _optimised(spark, d)
    edits = bound(spark, d, "lines").where("line_no = 1").select("bid_id", "line_no", F.lit(99.5).alias("price"), (F.col("bid_id") % 2 == 1).alias("locked"))
    return pricing.apply_price_overrides(priced, edits).select("bid_id", "line_no", "price", "strategy")


@query("bid_verdict", """WITH b AS (SELECT o_orderkey AS bid_id, (o_orderkey % 100) / 100.0 AS p, CAST(o_custkey % 20 AS DOUBLE) AS m, o_orderkey % 5 + 1 AS rank, o_orderkey % 11 = 0 AS no FROM orders)
SELECT bid_id, CASE WHEN no THEN 'Do not bid' WHEN (p >= 0.55 AND m >= 10) OR (rank = 1 AND m >= 5) THEN 'Strong' WHEN p >= 0.35 OR rank = 1 THEN 'Competitive' ELSE 'Stretch' END AS verdict FROM b""")
def q_bid_verdict(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id"), ((F.col("o_orderkey") % 100) / 100).alias("win_probability"), (F.col("o_custkey") % 20).cast("double").alias("margin_pct"), (F.col("o_orderkey") % 5 + 1).alias("rank"), F.when(F.col("o_orderkey") % 11 == 0, "Do not bid").otherwise("Bid").alias("recommendation"))
    return pricing.bid_verdict(rows).select("bid_id", "verdict")


@query("leave_one_group_out", """WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12), t AS (SELECT g.p_brand, avg(p_retailprice) AS m FROM g JOIN part p ON p.p_brand <> g.p_brand GROUP BY 1)
SELECT p_brand AS brand, count(*) AS n, round(any_value(m), 4) AS guess FROM part JOIN t USING (p_brand) GROUP BY 1""")
def q_logo(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_retailprice")
    found = ledger.leave_one_group_out(rows, "brand", lambda df: df.agg(F.avg("p_retailprice")).first()[0], lambda m, df: df.withColumn("guess", F.lit(m)))
    return found.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("guess"), 4).alias("guess"))
