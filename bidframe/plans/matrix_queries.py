"""Registered queries of tender units, the compliance matrix and small table operators; texts are composed, the SQL states the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import matrix
from bidframe.operators import specs as spec
from bidframe.plans.bindings import TAX_RULES, bound, cte, spread, table, tax_rules, values
from bidframe.plans.queries import query
from bidframe.plans.rule_queries import _pick, _pick_sql

# (category, source, text, status, severity and risk); the bids: domestic, lead time 10 days, 24x7 desk, office in town, small and local
CLAUSES = [
    ("technical", "text", "The bidder shall follow the drawings", "Complies", None, None), ("delivery", "text", "All goods shall be delivered within three weeks", "Complies", None, None),
    ("delivery", "text", "Supply within 10 days of the order", "Complies with note", None, None), ("delivery", "text", "Installation to be completed within 5 days", "Deviation", None, None),
    ("delivery", "text", "Submit a delivery plan within 2 days", "Complies", None, None), ("warranty", "text", "Goods carry a warranty of 1 year", "Complies", None, None),
    ("warranty", "text", "Standby units shall be kept at the site", "Complies", None, None), ("warranty", "text", "Round the clock help is needed", "Complies", None, None),
    ("warranty", "text", "Respond to complaints within 2 hours", "Complies with note", "medium", "On-site response obligation"), ("warranty", "text", "Attend to complaints within 24 hours", "Complies", None, None),
    ("warranty", "text", "A resident engineer is needed", "Complies with note", "low", "Resident engineer"), ("standards", "text", "ISO 9001 and ISO/IEC 27001 certified", "Complies", None, None),
    ("standards", "text", "ISO 9001 and GDPR rules apply", "Complies with note", None, None), ("standards", "text", "RoHS marks on all goods", "Clarification required", None, None),
    ("commercial", "text", "We pay within 30 days of the invoice", "Complies", None, None), ("commercial", "text", "Payment is made within 60 days of receipt", "Complies with note", "medium", "Payment beyond 45 days"),
    ("commercial", "text", "Liquidated damages of 0.5 % per week up to a maximum of 15 %", "Complies with note", "high", "Liquidated damages"), ("commercial", "text", "Liquidated damages of 1 % a week, maximum 10 %", "Complies with note", "low", "Liquidated damages"),
    ("commercial", "text", "Performance security of 3 % is due", "Complies", "low", "Performance security"), ("commercial", "text", "The EMD is forfeited on withdrawal", "Complies", None, None),
    ("commercial", "text", "Advance against a bank guarantee", "Complies with note", None, None), ("commercial", "text", "Prices are firm", "Complies with note", None, None),
    ("legal", "text", "Unlimited liability of the bidder", "Deviation", "high", "Unlimited liability"), ("legal", "text", "The bidder indemnifies the buyer", "Complies with note", None, None),
    ("legal", "text", "The buyer may terminate for convenience", "Complies with note", "low", "Termination for convenience"), ("legal", "text", "Personal data under GDPR", "Clarification required", None, None),
    ("legal", "text", "Sub-contracting needs consent", "Complies with note", None, None), ("legal", "text", "Courts of the buyer's city", "Complies", None, None), ("submission", "text", "Bids go to the portal", "Noted", None, None),
    ("scope", "text", "Train the staff", "Complies", None, None),
]
HELD = ["iso9001", "iso27001"]


@query("compliance_matrix", f"""WITH {cte('lines', 'products')}, r AS (SELECT l_orderkey AS bid_id, l_linenumber, l_partkey % {len(CLAUSES)} + 1 AS k, l_suppkey % 11 = 0 AS fixed FROM lineitem WHERE l_orderkey % 2 = 0 OR l_suppkey % 3 > 0),
c AS (SELECT bid_id, fixed, {[c[0] for c in CLAUSES]}[k] AS category, {[c[3] for c in CLAUSES]}[k] AS status, [{', '.join('NULL' if c[5] is None else repr(c[5]) for c in CLAUSES)}][k] AS risk FROM r)
SELECT category, CASE WHEN fixed THEN 'Deviation' ELSE status END AS status, risk, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def q_matrix(spark, d):
    rows = table(spark, d, "lineitem")
    k = F.col("l_partkey")
    # clauses of the buyer give no answer
    reqs = rows.select(
        F.col("l_orderkey").alias("bid_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").cast("string").alias("req_id"), _pick(k, [c[2] for c in CLAUSES]).alias("text"),
        _pick(k, [c[0] for c in CLAUSES]).alias("category"), F.lit("mandatory").alias("strength"), F.when((F.col("l_orderkey") % 2 == 0) | (F.col("l_suppkey") % 3 > 0), "bidder").otherwise("buyer").alias("actor"),
        _pick(k, [c[1] for c in CLAUSES]).alias("source"), F.lit(None).cast("int").alias("line_no"), F.lit(False).alias("evidenced"), F.lit(None).cast("double").alias("fit"), F.lit(False).alias("failed"), F.lit(None).cast("boolean").alias("met"), F.lit("scope").alias("type"), F.lit(None).cast("string").alias("product_os"), "l_suppkey")
    bids = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("bid_id"), (F.col("o_orderkey") % 3 > 0).alias("long_form"), F.lit(10).alias("lead_time_days"), F.lit(True).alias("domestic"), F.lit("Town").alias("client_city"), F.lit(True).alias("has_office"),
        F.lit(True).alias("helpdesk_24x7"), F.lit(8).alias("response_hours"), F.lit(True).alias("small_local"))
    lines = bound(spark, d, "lines").join(bound(spark, d, "products").select("sku", "category", "warranty_months"), "sku").select("bid_id", "line_no", "category", "warranty_months", F.lit(False).alias("extended"))
    checks = bids.select("bid_id", F.lit(1).alias("check_no"), F.lit("nothing").alias("text"), F.lit("Meets").alias("verdict"))
    fixed = reqs.where("l_suppkey % 11 = 0").select("bid_id", "req_id", F.lit("Deviation").alias("status")).distinct()
    found = matrix.compliance_matrix(reqs.drop("l_suppkey"), bids, lines, checks, HELD, fixed)
    return found.groupBy("category", "status", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("eligibility_matrix", f"""WITH v AS (SELECT c_custkey AS bid_id, {_pick_sql('c_custkey', ('Meets', 'Documents required', 'Needs review', 'Does not meet', None))} AS v FROM customer) SELECT bid_id, CASE v WHEN 'Meets' THEN 'Complies' WHEN 'Does not meet' THEN 'Deviation' ELSE CASE WHEN v IS NULL THEN 'Noted' ELSE 'Complies with note' END END AS eligibility,
CASE bid_id % 4 WHEN 0 THEN 'Complies' WHEN 1 THEN 'Complies with note' WHEN 2 THEN 'Deviation' ELSE 'Clarification required' END AS specification FROM v""")
def q_eligibility_matrix(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("bid_id"))
    k = F.col("bid_id")
    base = [F.lit("mandatory").alias("strength"), F.lit("bidder").alias("actor"), F.lit("table").alias("source"), F.lit(False).alias("evidenced"), F.lit(False).alias("failed"), F.lit("eligibility").alias("type"), F.lit(None).cast("string").alias("product_os"), F.lit(None).cast("boolean").alias("met")]
    none = F.lit(None).cast("double")
    reqs = c.select("bid_id", F.lit(1).alias("req_id"), F.lit("Turnover of 3 crore").alias("text"), F.lit("eligibility").alias("category"), F.lit(None).cast("int").alias("line_no"), none.alias("fit"), *base).unionByName(
        c.select("bid_id", F.lit(2).alias("req_id"), F.lit("Memory: 16 GB").alias("text"), F.lit("technical").alias("category"), F.when(k % 4 < 3, 1).alias("line_no"), F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.8).alias("fit"), *base[:-1], F.when(k % 4 == 2, False).alias("met")))
    bids = c.select("bid_id", F.lit(True).alias("long_form"), F.lit(0).alias("lead_time_days"), F.lit(True).alias("domestic"), F.lit("T").alias("client_city"), F.lit(True).alias("has_office"), F.lit(True).alias("helpdesk_24x7"), F.lit(8).alias("response_hours"), F.lit(True).alias("small_local"))
    lines = c.select("bid_id", F.lit(1).alias("line_no"), F.lit("laptop").alias("category"), F.lit(12).alias("warranty_months"), F.lit(False).alias("extended"))
    verdict = _pick(k, ("Meets", "Documents required", "Needs review", "Does not meet", None))
    # of two checks of one text the later counts
    checks = c.select("bid_id", F.lit("TURNOVER of 3 crore").alias("text"), F.explode(F.array(F.struct(F.lit(2).alias("check_no"), verdict.alias("verdict")), F.struct(F.lit(1).alias("check_no"), F.lit("Meets").alias("verdict")))).alias("c")).select("bid_id", "text", "c.*")
    found = matrix.compliance_matrix(reqs, bids, lines, checks, HELD, c.limit(0).select("bid_id", F.lit(1).alias("req_id"), F.lit("x").alias("status")))
    return found.groupBy("bid_id").agg(F.max(F.when(F.col("req_id") == 1, F.col("status"))).alias("eligibility"), F.max(F.when(F.col("req_id") == 2, F.col("status"))).alias("specification"))


@query("matrix_thresholds", """WITH r AS (SELECT l_orderkey AS bid_id, l_linenumber, l_partkey % 5 AS k, CAST(l_quantity AS INT) AS n FROM lineitem),
a AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN n >= 12 THEN 'Complies' WHEN 12 <= n * 1.5 THEN 'Complies with note' ELSE 'Deviation' END WHEN 1 THEN CASE WHEN n > 45 THEN 'Complies with note' ELSE 'Complies' END
WHEN 2 THEN 'Complies with note' WHEN 3 THEN CASE WHEN n > 24 THEN 'Deviation' WHEN bid_id % 2 = 0 THEN 'Complies with note' ELSE 'Complies' END ELSE CASE WHEN n >= 8 THEN 'Complies' ELSE 'Complies with note' END END AS status,
CASE WHEN k = 1 AND n > 45 THEN 'medium' WHEN k = 2 THEN CASE WHEN n > 10 THEN 'high' ELSE 'low' END WHEN k = 4 AND n < 8 THEN 'medium' END AS severity FROM r)
SELECT k, n AS number, status, severity, count(*) AS clauses FROM a GROUP BY 1, 2, 3, 4""")
def q_thresholds(spark, d):
    k, n = F.col("l_partkey") % 5, F.col("l_quantity").cast("int")
    said = lambda before, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    text = F.when(k == 0, said("Goods are delivered within ", " days")).when(k == 1, said("Payment falls due within ", " days")).when(k == 2, said("Liquidated damages of 0.5 % per week, maximum ", " %")).when(
        k == 3, said("The goods carry a warranty of ", " months")).otherwise(said("Respond to complaints within ", " hours"))
    lineitem = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    reqs = spread(lineitem, "l_orderkey").select(
        F.col("l_orderkey").alias("bid_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", k.alias("k"), n.alias("n")).alias("req_id"), text.alias("text"), _pick(k, ("delivery", "commercial", "commercial", "warranty", "warranty")).alias("category"),
        F.lit("commercial").alias("type"), F.lit("mandatory").alias("strength"), F.lit("bidder").alias("actor"), F.lit("text").alias("source"), F.lit(None).cast("int").alias("line_no"), F.lit(False).alias("evidenced"),
        F.lit(None).cast("double").alias("fit"), F.lit(False).alias("failed"), F.lit(None).cast("boolean").alias("met"), F.lit(None).cast("string").alias("product_os"))
    bids = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("bid_id"), F.lit(True).alias("long_form"), F.lit(10).alias("lead_time_days"), F.lit(True).alias("domestic"), F.lit(None).cast("string").alias("client_city"), F.lit(False).alias("has_office"),
        F.lit(True).alias("helpdesk_24x7"), F.lit(8).alias("response_hours"), F.lit(True).alias("small_local"))
    lines = bids.select("bid_id", F.lit(1).alias("line_no"), F.lit("laptop").alias("category"), F.lit(24).alias("warranty_months"), (F.col("bid_id") % 2 == 0).alias("extended"))
    checks = bids.select("bid_id", F.lit(1).alias("check_no"), F.lit("nothing").alias("text"), F.lit("Meets").alias("verdict"))
    none = reqs.select("bid_id", "req_id", F.lit("x").alias("status")).limit(0)
    found = matrix.compliance_matrix(reqs, bids, lines, checks, HELD, none)
    return found.groupBy(F.col("req_id.k").alias("k"), F.col("req_id.n").alias("number"), "status", "severity").agg(F.count(F.lit(1)).alias("clauses"))


@query("spec_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS n, p_size, l_partkey % 6 AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN p_size >= n THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN p_size < n THEN 0.0 ELSE greatest(0.5, 1 - (1000 * p_size - 1000 * n) / (1000.0 * n)) END WHEN 2 THEN CASE WHEN abs(p_size - n) <= 0.5 THEN 1.0 WHEN abs(p_size - n) <= 1.5 THEN 0.6 ELSE 0.0 END
WHEN 3 THEN CASE WHEN p_size = n THEN 1.0 WHEN p_size > n THEN 0.6 ELSE 0.0 END WHEN 4 THEN CASE WHEN l_partkey % 4 = 0 THEN 1.0 ELSE 0.2 END END AS fit FROM r)
SELECT k, count(*) AS n, round(sum(fit), 6) AS fit, count(*) FILTER (WHERE (k IN (0, 1) AND p_size < n) OR (k = 4 AND l_partkey % 4 <> 0)) AS failed, count(*) FILTER (WHERE k = 5) AS systems FROM s WHERE k <> 2 OR n >= 10 GROUP BY 1""")
def q_spec_rows(spark, d):
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey").withColumn("k", F.col("l_partkey") % 6).withColumn("n", F.col("l_quantity").cast("int"))
    k, n = F.col("k"), F.col("n").cast("string")
    said = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    text = F.when(k == 0, said("Memory: minimum ", " GB")).when(k == 1, said("UPS rating: ", " kVA")).when(k == 2, said("Display: ", "-inch")).when(k == 3, said("Switch: ", "-port")).when(k == 4, "Rack: 2U").otherwise("Operating system: any")
    # screens are read from two digits on
    reqs = rows.where((k != 2) | (F.col("n") >= 10)).select(F.col("l_orderkey").alias("bid_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").cast("string").alias("line_no"), "k", "n", text.alias("text"), "l_partkey")
    lines = reqs.select("bid_id", "line_no", F.col("l_partkey").alias("sku"), F.lit("laptop").alias("category")).distinct()
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    thousands = (1000 * F.col("p_size")).cast("string")
    specs = F.map_from_entries(F.array(*(F.struct(F.lit(a).alias("k"), v.alias("v")) for a, v in [
        ("ram_gb", size), ("capacity_va", thousands), ("screen_in", size), ("ports", size), ("form_factor", F.when(key % 4 == 0, "2U rack").otherwise("tower")), ("os", F.lit("Windows 11 Pro"))])))
    products = table(spark, d, "part").select(key.alias("sku"), specs.alias("specs"), F.lower("p_name").alias("described"))
    found = spec.spec_rows(reqs.drop("l_partkey"), lines, products)
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("fit"), 6).alias("fit"), F.count_if("failed").alias("failed"), F.count_if(F.col("fit").isNull() & (F.col("product_os") == "Windows 11 Pro")).alias("systems"))


@query("matrix_risks", """SELECT o_custkey % 50 AS bid_id, risk, CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, 'R' || (o_orderkey % 7) AS risk, ['high', 'medium', 'low'][o_orderkey % 3 + 1] AS severity FROM orders) GROUP BY 1, 2""")
def q_matrix_risks(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("bid_id"), F.concat(F.lit("R"), (F.col("o_orderkey") % 7).cast("string")).alias("risk"), _pick(F.col("o_orderkey"), ("high", "medium", "low")).alias("severity"))
    return matrix.matrix_risks(rows)


@query("build_units", """WITH b AS (SELECT p_partkey AS doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS pos, * FROM part)
SELECT doc_id, pos, CASE pos WHEN 1 THEN p_name || ': ' || p_size || ' ' || p_type WHEN 3 THEN 'Date: ' || p_size WHEN 5 THEN 'Goods of ' || p_brand || ' go to the store' ELSE 'The bidder shall deliver ' || p_name END AS text,
CASE WHEN pos = 5 THEN '4.2' WHEN pos = 1 THEN '3 (7)' ELSE '3' END AS clause, CASE pos WHEN 1 THEN 'table' WHEN 3 THEN 'field' ELSE 'text' END AS source FROM b WHERE pos IN (1, 3, 5, 6)""")
def q_units(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    none = F.lit(None).cast("array<string>")

    def block(pos, kind, text, cells=none, heading=False):
        return F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), cells.alias("cells"), F.lit(heading).alias("is_heading"))

    # a table's header and row, an address, a field, a heading, a numbered clause, a clause
    blocks = F.array(
        block(0, "row", F.lit(""), F.array(F.lit("No"), F.lit("Parameter"), F.lit("Value"), F.lit("Kind"))), block(1, "row", F.lit(""), F.array(F.lit("7."), F.col("p_name"), size, F.col("p_type"))),
        block(2, "text", F.lit("12 Long Road, Town 560001")), block(3, "text", F.concat(F.lit("Date: "), size)), block(4, "text", F.lit("Scope"), heading=True),
        block(5, "text", F.concat(F.lit("4.2 Goods of "), F.col("p_brand"), F.lit(" go to the store"))), block(6, "text", F.concat(F.lit("The bidder\tshall deliver "), F.col("p_name"))))
    rows = p.select(F.col("p_partkey").alias("doc_id"), F.explode(blocks).alias("b")).select("doc_id", "b.*").withColumn("page", F.lit(1)).withColumn("owner", F.lit(1)).withColumn("table_no", F.when(F.col("kind") == "row", 1))
    sections = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("section"), F.lit("technical").alias("kind"), F.lit("3").alias("number"))
    return matrix.build_units(rows, sections).select("doc_id", "pos", "text", "clause", "source")


@query("same_market", "SELECT o_orderkey, s_nationkey = 3 AND c_nationkey = 3 AS same FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = o_orderkey % 50")
def q_same_market(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 50)
    return rows.select("o_orderkey", matrix.same_market(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "N3").alias("same"))


@query("typed_specs", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS ram_gb, CASE p_partkey % 3 WHEN 0 THEN '4K' WHEN 1 THEN 'FHD' END AS resolution, CAST(CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 7 END AS INT) AS cpu_tier, CASE WHEN p_partkey % 4 = 3 THEN 'xeon' END AS cpu_family,
CAST(p_size AS INT) AS uplink_gbps, CASE p_partkey % 2 WHEN 0 THEN '2U' ELSE 'tower' END AS form_factor FROM part""")
def q_typed(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    specs = F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in [
        ("ram_gb", size), ("resolution", F.when(k % 3 == 0, "3840 x 2160").when(k % 3 == 1, "1920 x 1080").otherwise("")), ("cpu", _pick(k, ("Core i5 12th", "i7-1355U", "Apple M3", "Xeon Gold"))), ("uplinks", F.concat(F.lit("4 x "), size, F.lit("G SFP"))), ("form_factor", F.when(k % 2 == 0, "2U rack").otherwise("Mini Tower")), ("bays", F.lit("many"))])))
    return table(spark, d, "part").select("p_partkey", matrix.typed_specs(specs).alias("s")).select("p_partkey", "s.ram_gb", "s.resolution", "s.cpu_tier", "s.cpu_family", "s.uplink_gbps", "s.form_factor")


@query("semi_search", f"WITH {cte('products')}, h AS (SELECT l_partkey AS sku, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1) SELECT sku, score, CAST(row_number() OVER (ORDER BY score DESC, sku) AS INT) AS position FROM products JOIN h USING (sku)")
def q_semi_search(spark, d):
    hits = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return matrix.semi_search(bound(spark, d, "products"), hits).select("sku", "score", "position")


@query("recent_imports", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def q_recent(spark, d):
    return matrix.recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))


@query("tax_rules_sorted", f"WITH {values(TAX_RULES, 'rule_no, country, region, tax_category, name, rate_pct', 'r')}, c AS (SELECT {_pick_sql('n_nationkey', ('IN', 'US', 'AE', 'DE', 'CA'))} AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT country, region, rule_no, n FROM r JOIN c USING (country)")
def q_tax_sorted(spark, d):
    used = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(_pick(F.col("n_nationkey"), ("IN", "US", "AE", "DE", "CA")).alias("country")).agg(F.count(F.lit(1)).alias("n"))
    return matrix.tax_rules_sorted(tax_rules(spark).join(used.hint("merge"), "country")).select("country", "region", "rule_no", "n")


@query("except_rows", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey % 2 = 0 AND (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey % 2 = 1) GROUP BY 1, 2")
def q_except(spark, d):
    rows = table(spark, d, "lineitem")
    return matrix.except_rows(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), ["l_orderkey", "l_partkey"]).groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_in_order", "SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda s: s.x), ' ') AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL)")
def q_distinct(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(words, " ").alias("words"))
