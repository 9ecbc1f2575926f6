"""Registered queries of parsing functions, clause rules and compliance checks.

Texts are composed from the columns of the driver's tables, and the SQL states
what a composed text must give; it does not repeat the functions' patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.functions import scalars, text
from bidframe.operators import compliance, corpus, tender
from bidframe.plans.bindings import bound, cte, table
from bidframe.plans.queries import query
from bidframe.sources.imports import infer_category


def _pick(number, values):
    """The value of a composed column by a number, in rotation."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _pick_sql(number: str, values) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in values)}][({number}) % {len(values)} + 1]"


# ---- numbers, durations, dates, names

@query("parse_months", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 12 * p_size WHEN 1 THEN p_size WHEN 2 THEN 120 WHEN 3 THEN 0 ELSE 12 * p_size END AS INT) AS months, CAST(p_partkey * 1237 AS BIGINT) AS number FROM part")
def q_parse_months(spark, d):
    size = F.col("p_size").cast("string")
    term = F.get(F.array(F.concat(size, F.lit(" years")), F.concat(size, F.lit(" Months")), F.lit("Lifetime"), F.lit("no warranty"), F.concat(F.lit("std. "), size, F.lit(" yrs"))), (F.col("p_partkey") % 5).cast("int"))
    number = F.concat(F.lit("about "), F.format_number(F.col("p_partkey") * 1237, 0), F.lit(" pcs"))
    return table(spark, d, "part").select("p_partkey", scalars.parse_months(term).alias("months"), scalars.parse_int(number).alias("number"))


@query("parse_inr", "SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN x WHEN 1 THEN x * 100000 WHEN 2 THEN x * 10000000 END, 2) AS amount FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS x FROM orders)")
def q_parse_inr(spark, d):
    x = F.floor("o_totalprice")
    t = F.get(F.array(F.concat(F.lit("EMD: Rs. "), F.format_number(x, 0), F.lit(" only")), F.concat(F.lit("at least INR "), x.cast("string"), F.lit(" lakh each")), F.concat(F.lit("worth "), x.cast("string"), F.lit(" crore")), F.lit("none")), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.round(scalars.parse_inr(t), 2).alias("amount"))


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


@query("parse_number_words", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_linenumber % 3 WHEN 0 THEN 300 ELSE 0 END + l_quantity AS DOUBLE) AS n FROM lineitem")
def q_number_words(spark, d):
    n = F.col("l_quantity").cast("int")
    unit = F.get(F.array(*map(F.lit, _SMALL)), n % 10)
    ten = F.get(F.array(*map(F.lit, _TENS)), F.floor(n / 10).cast("int") - 2)
    words = F.when(n < 20, F.get(F.array(*map(F.lit, _SMALL)), n)).when(n % 10 == 0, ten).otherwise(F.concat_ws("-", ten, unit))
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("three hundred and "), words)).otherwise(words)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.parse_number_words(said).alias("n"))


@query("duration_days", f"SELECT p_partkey, CAST(p_size * {_pick_sql('p_partkey', (1, 7, 30, 365))} AS INT) AS days FROM part")
def q_duration(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.duration_days(F.col("p_size"), _pick(F.col("p_partkey"), ("day", "Weeks", "month", "years"))).alias("days"))


@query("parse_date_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def q_dates(spark, d):
    layouts = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.coalesce(*(F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", f)) for k, f in enumerate(layouts)), F.lit("to be told"))
    return table(spark, d, "orders").select("o_orderkey", scalars.parse_date_multi(said).alias("day"))


@query("names", "SELECT p_partkey, replace(lower(p_name), ' ', '_') || '_' || replace(replace(lower(p_brand), '#', '_'), ' ', '_') AS slug, lower(p_name) || ' % ' || replace(lower(p_brand), '#', ' ') AS header FROM part")
def q_names(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.slug(F.concat(F.lit(" "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("."))).alias("slug"),
                                          scalars.norm_header(F.concat(F.lit("("), F.upper("p_name"), F.lit(") % ["), F.col("p_brand"), F.lit("]"))).alias("header"))


@query("tax_codes", "SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) IN (2, 4, 6) AS hsn, p_size IN (0, 3, 5, 12, 18, 28, 40) AS slab FROM part")
def q_tax_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.hsn_valid(F.concat(F.lit("85."), F.col("p_partkey").cast("string"))).alias("hsn"), scalars.gst_slab_valid(F.col("p_size").cast("double")).alias("slab"))


_WARES = [("Laptop 14 inch", "laptop"), ("LED display", "monitor"), ("flatbed scanner", "printer"), ("PoE switch", "network"), ("Online UPS", "power"), ("USB headset", "audio"), ("Wireless Mouse", "peripheral"), ("Office licence", "software"), ("Oak chair", None)]


@query("infer_category", f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'audio' ELSE {_pick_sql('p_partkey', [c for _, c in _WARES])} END AS category FROM part")
def q_category(spark, d):
    given = F.when(F.col("p_partkey") % 4 == 0, "Audio").when(F.col("p_partkey") % 4 == 1, "unheard of")
    return table(spark, d, "part").select("p_partkey", infer_category(given, _pick(F.col("p_partkey"), [w for w, _ in _WARES])).alias("category"))


@query("normalize", "SELECT p_partkey, '\"' || p_name || '\" - ' || p_size || 'x3' || chr(9) || p_brand || ' x' || chr(10) || 'y' AS t FROM part")
def q_normalize(spark, d):
    said = F.concat(F.lit("  “"), F.col("p_name"), F.lit("” – "), F.col("p_size").cast("string"), F.lit("×3    "), F.col("p_brand"), F.lit("  x \n  y "))
    return table(spark, d, "part").select("p_partkey", text.normalize(said).alias("t"))


@query("dehyphenate", "SELECT doc_id, md5(replace(regexp_replace(text, '-\\n([a-z])', '\\1', 'g'), chr(10), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def q_dehyphenate(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.dehyphenate(F.split("text", "\n"))).alias("digest"))


# ---- clauses: who does what

_WHO = [("The bidder", "bidder"), ("The Purchaser", "buyer"), ("The purchaser's agent", "bidder"), ("4.1 University", "buyer"), ("We", "buyer"), ("Supplier", "bidder"), ("Goods", "bidder")]
_DOES = [("shall deliver", "mandatory"), ("should deliver", "mandatory"), ("must not deliver", "mandatory"), ("may also offer", "desirable"), ("delivers", "information"), ("reserves the right to keep", "told")]


@query("modality", f"""WITH c AS (SELECT {_pick_sql('l_suppkey', [a for _, a in _WHO])} AS who, {_pick_sql('l_partkey', [s for _, s in _DOES])} AS s, l_linenumber % 3 = 0 AS named FROM lineitem)
SELECT CASE WHEN s = 'told' THEN 'information' ELSE s END AS strength, CASE WHEN s = 'told' THEN 'buyer' WHEN named THEN 'bidder' ELSE who END AS actor, count(*) AS n FROM c GROUP BY 1, 2""")
def q_modality(spark, d):
    tail = F.when(F.col("l_linenumber") % 3 == 0, " to the bidder.").otherwise(" to the site on time, if the bidder asks.")
    clause = F.concat(_pick(F.col("l_suppkey"), [w for w, _ in _WHO]), F.lit(" "), _pick(F.col("l_partkey"), [v for v, _ in _DOES]), F.lit(" all of the goods in one lot"), tail)
    short = F.concat(_pick(F.col("l_suppkey"), [w for w, _ in _WHO]), F.lit(" "), _pick(F.col("l_partkey"), [v for v, _ in _DOES]), F.lit(" bidder goods"))
    said = F.when(F.col("l_linenumber") % 3 == 0, short).otherwise(clause)
    return table(spark, d, "lineitem").select(text.modality(said).alias("m")).groupBy("m.strength", "m.actor").agg(F.count(F.lit(1)).alias("n"))


_SAYS = [("EMD of 2 % is due", "commercial"), ("an ISO 9001 certificate, certified", "standards"), ("complaints within a day", "warranty"), ("delivery at the site", None), ("some words", None)]
_KINDS = [("eligibility", "eligibility", True), ("boq", "technical", True), ("conditions", "legal", False), ("notice", "submission", False), (None, None, False)]
_TYPES = [("delivery", "delivery"), ("payment", "commercial"), ("unheard", "scope")]


@query("clause_category", f"""WITH c AS (SELECT {_pick_sql('l_suppkey', [c for _, c in _SAYS])} AS word, l_suppkey % 5 = 3 AS delivers, {_pick_sql('l_partkey', [c for _, c, _ in _KINDS])} AS kind, {_pick_sql('l_partkey', [x for _, _, x in _KINDS])} AS decides,
{_pick_sql('l_orderkey', [c for _, c in _TYPES])} AS type, l_linenumber % 2 = 0 AS long, l_quantity >= 20 AS sure FROM lineitem)
SELECT CASE WHEN long AND decides THEN kind WHEN word IS NOT NULL THEN word WHEN long AND kind IS NOT NULL THEN kind WHEN delivers AND type = 'delivery' THEN 'delivery' WHEN sure THEN type ELSE 'scope' END AS category, count(*) AS n FROM c GROUP BY 1""")
def q_clause_category(spark, d):
    rows = table(spark, d, "lineitem")
    category = text.clause_category(_pick(F.col("l_suppkey"), [s for s, _ in _SAYS]), _pick(F.col("l_partkey"), [k for k, _, _ in _KINDS]), _pick(F.col("l_orderkey"), [t for t, _ in _TYPES]),
                                    F.when(F.col("l_quantity") >= 20, 0.45).otherwise(0.44), F.col("l_linenumber") % 2 == 0)
    return rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


_ASKED = ["supply of computer hardware", "ICT system integration", "technology equipment", "printing"]
_HELD = ["IT hardware supply", "System Integration", "sales and trading", "Printing of forms"]
_SAME = {(0, 0), (1, 1), (0, 2), (3, 3)}  # "supply of computer hardware" holds all of "sales and trading", which is supply


@query("same_segment", f"SELECT l_partkey % 4 AS asked, l_suppkey % 4 AS held, {' OR '.join(f'(l_partkey % 4 = {a} AND l_suppkey % 4 = {b})' for a, b in sorted(_SAME))} AS same, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def q_same_segment(spark, d):
    rows = table(spark, d, "lineitem").withColumn("same", text.same_segment(_pick(F.col("l_partkey"), _ASKED), _pick(F.col("l_suppkey"), _HELD)))
    return rows.groupBy((F.col("l_partkey") % 4).alias("asked"), (F.col("l_suppkey") % 4).alias("held"), "same").agg(F.count(F.lit(1)).alias("n"))


@query("warranty_terms", "SELECT p_partkey, CAST(12 * (1 + p_size % 6) AS INT) AS months, CAST(12 * (1 + p_size % 6) AS INT) AS power, CAST(p_size AS INT) AS audio FROM part")
def q_warranty(spark, d):
    years = _pick(F.col("p_size"), ("one", "2", "three", "four", "5", "six"))
    said = F.concat(F.lit("UPS units carry "), years, F.lit(" years and headsets "), F.col("p_size").cast("string"), F.lit(" months of warranty."))
    rows = table(spark, d, "part").select("p_partkey", text.warranty_months(said).alias("months"), text.warranty_by_category(said).alias("m"))
    return rows.select("p_partkey", "months", F.try_element_at("m", F.lit("power")).alias("power"), F.try_element_at("m", F.lit("audio")).alias("audio"))


# ---- compliance

_STATUS = ["Complies", "Complies with note", "Deviation", "Noted", "Needs review"]
_ITEMS_SQL = f"SELECT l_orderkey AS bid_id, {_pick_sql('l_partkey', _STATUS)} AS status, l_suppkey % 2 = 0 AS mandatory FROM lineitem"


def _items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bid_id"), _pick(F.col("l_partkey"), _STATUS).alias("status"), (F.col("l_suppkey") % 2 == 0).alias("mandatory"))


@query("compliance_counts", f"""SELECT bid_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower().replace(' ', '_')}" for s in _STATUS)},
count(*) FILTER (WHERE mandatory AND status <> 'Noted') AS mandatory_total, count(*) FILTER (WHERE mandatory AND status IN ('Complies', 'Complies with note')) AS mandatory_met FROM ({_ITEMS_SQL}) GROUP BY 1""")
def q_counts(spark, d):
    return compliance.compliance_counts(_items(spark, d))


_CHECKS_SQL = f"SELECT l_orderkey AS bid_id, {_pick_sql('l_partkey + l_suppkey', compliance.VERDICTS)} AS verdict FROM lineitem WHERE l_quantity > 30"
_VERDICT_SQL = f"SELECT o_orderkey AS bid_id, CASE WHEN bool_or(verdict = 'Does not meet') THEN 'Does not meet' WHEN bool_or(verdict = 'Needs review') THEN 'Needs review' WHEN bool_or(verdict = 'Documents required') THEN 'Documents required' WHEN count(verdict) > 0 THEN 'Meets' ELSE 'Not assessed' END AS eligibility FROM orders LEFT JOIN ({_CHECKS_SQL}) c ON c.bid_id = o_orderkey GROUP BY 1"


def _verdicts(spark, d):
    checks = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("bid_id"), _pick(F.col("l_partkey") + F.col("l_suppkey"), compliance.VERDICTS).alias("verdict"))
    return compliance.eligibility_verdict(table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id")), checks)


@query("eligibility_verdict", _VERDICT_SQL)
def q_verdict(spark, d):
    return _verdicts(spark, d)


@query("bid_recommendation", f"""WITH v AS ({_VERDICT_SQL}), i AS (SELECT bid_id, bool_or(mandatory AND status = 'Deviation') AS dev, bool_or(status = 'Needs review') AS rev FROM ({_ITEMS_SQL}) GROUP BY 1), r AS (SELECT v.*, coalesce(dev, false) AS dev, coalesce(rev, false) AS rev, o_totalprice > 200000 AS high FROM v JOIN orders ON o_orderkey = v.bid_id LEFT JOIN i ON i.bid_id = v.bid_id)
SELECT bid_id, CASE WHEN eligibility = 'Does not meet' THEN 'Do not bid' WHEN dev OR high OR rev OR eligibility = 'Needs review' THEN 'Bid with clarifications' ELSE 'Bid' END AS recommendation,
CAST((eligibility = 'Does not meet')::INT + dev::INT + high::INT + (rev OR eligibility = 'Needs review')::INT AS INT) AS reasons FROM r""")
def q_recommendation(spark, d):
    risks = table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id"), F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("severity"))
    return compliance.bid_recommendation(_verdicts(spark, d), _items(spark, d), risks).select("bid_id", "recommendation", F.size("reasons").alias("reasons"))


@query("matrix_requirements", f"""WITH r AS (SELECT l_orderkey, {_pick_sql('l_partkey', ('bidder', 'buyer'))} AS actor, {_pick_sql('l_suppkey', ('mandatory', 'information', 'desirable'))} AS strength, {_pick_sql('l_linenumber', ('scope', 'warranty', 'legal'))} AS category,
{_pick_sql('CAST(l_quantity AS INT)', ('scope', 'commercial', None))} AS type, l_orderkey % 2 = 0 AS long FROM lineitem)
SELECT strength, category, coalesce(type, 'none') AS type, count(*) AS n FROM r WHERE actor = 'bidder' AND (strength <> 'information' OR (coalesce(type, '') <> 'scope' AND (NOT long OR category = 'warranty'))) GROUP BY 1, 2, 3""")
def q_matrix_requirements(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", _pick(F.col("l_partkey"), ("bidder", "buyer")).alias("actor"), _pick(F.col("l_suppkey"), ("mandatory", "information", "desirable")).alias("strength"), _pick(F.col("l_linenumber"), ("scope", "warranty", "legal")).alias("category"),
        _pick(F.col("l_quantity").cast("int"), ("scope", "commercial", None)).alias("type"))
    kept = compliance.matrix_requirements(rows, F.col("l_orderkey") % 2 == 0)
    return kept.groupBy("strength", "category", F.coalesce("type", F.lit("none")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("requirement_counts", f"SELECT l_orderkey AS doc_id, l_linenumber AS section, count(*) AS n, count(*) FILTER (WHERE {_pick_sql('l_suppkey', ('mandatory', 'information', 'desirable'))} = 'mandatory') AS mandatory FROM lineitem GROUP BY 1, 2")
def q_requirement_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), _pick(F.col("l_suppkey"), ("mandatory", "information", "desirable")).alias("strength"))
    return tender.requirement_counts(rows)


@query("recent_credentials", "SELECT o_orderkey, o_orderpriority AS sector FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 3 * 365.25 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def q_credentials(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("completed_on"), F.col("o_orderpriority").alias("sector"))
    return compliance.recent_credentials(rows, F.lit("2000-01-01").cast("date"), 3, ["1-URGENT", "5-LOW"]).select("o_orderkey", "sector")


@query("turnover_check", """WITH y AS (SELECT o_custkey AS bid_id, year(o_orderdate) AS y, sum(o_totalprice) AS a FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY y DESC) AS n FROM y), g AS (SELECT bid_id, min(a) AS low, avg(a) AS mean FROM r WHERE n <= 3 GROUP BY 1)
SELECT bid_id, round(CASE WHEN bid_id % 2 = 0 THEN low ELSE mean END, 4) AS value, CASE WHEN CASE WHEN bid_id % 2 = 0 THEN low ELSE mean END >= 150000 + bid_id % 1000 + 0.5 THEN 'Meets' ELSE 'Does not meet' END AS verdict FROM g""")
def q_turnover(spark, d):
    turnover = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("bid_id"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum("o_totalprice").alias("amount"))
    criteria = table(spark, d, "customer").select(F.col("c_custkey").alias("bid_id"), F.lit(3).alias("years"), (F.col("c_custkey") % 2 == 0).alias("each_year"), (150000.5 + F.col("c_custkey") % 1000).alias("required"))
    return compliance.turnover_check(turnover, criteria).select("bid_id", F.round("value", 4).alias("value"), "verdict")


_OPTIONS = [(1, 3, 80000.0), (2, 2, 120000.0), (3, 1, 200000.0)]


@query("similar_works_check", f"""WITH o(option_no, n, threshold) AS (VALUES {', '.join(map(str, _OPTIONS))}), w AS (SELECT c_custkey, option_no, n, count(*) FILTER (WHERE o_totalprice >= threshold) AS k FROM customer CROSS JOIN o LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT c_custkey AS bid_id, CAST(min(option_no) FILTER (WHERE k >= n) AS INT) AS option_no, CASE WHEN count(*) FILTER (WHERE k >= n) > 0 THEN 'Meets' ELSE 'Does not meet' END AS verdict FROM w GROUP BY 1""")
def q_similar_works(spark, d):
    options = table(spark, d, "customer").select(F.col("c_custkey").alias("bid_id"), F.explode(F.array(*(F.struct(F.lit(o).alias("option_no"), F.lit(n).alias("n"), F.lit(t).alias("threshold")) for o, n, t in _OPTIONS))).alias("o")).select("bid_id", "o.*")
    works = table(spark, d, "orders").select(F.col("o_custkey").alias("bid_id"), F.col("o_totalprice").alias("value"))
    return compliance.similar_works_check(works, options).select("bid_id", "option_no", "verdict")


@query("supplied_quantity_check", f"WITH {cte('lines', 'products')}, q AS (SELECT l.supplier_id AS bid_id, p.category, sum(l.quantity) AS s FROM lines l JOIN products p USING (sku) GROUP BY 1, 2), c AS (SELECT s_suppkey AS bid_id, 'T' || (s_suppkey % 4) AS category, 3500 AS required FROM supplier) SELECT c.bid_id, c.category, CAST(coalesce(s, 0) AS BIGINT) AS supplied, CASE WHEN coalesce(s, 0) >= required THEN 'Meets' ELSE 'Does not meet' END AS verdict FROM c LEFT JOIN q ON q.bid_id = c.bid_id AND q.category = c.category")
def q_supplied(spark, d):
    rows = bound(spark, d, "lines").join(bound(spark, d, "products").select("sku", "category"), "sku")
    cred = rows.select(F.col("supplier_id").alias("bid_id"), F.create_map("category", "quantity").alias("devices"))
    criteria = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bid_id"), F.concat(F.lit("T"), (F.col("s_suppkey") % 4).cast("string")).alias("category"), F.lit(3500).alias("required"))
    return compliance.supplied_quantity_check(cred, criteria).select("bid_id", "category", F.col("supplied").cast("long").alias("supplied"), "verdict")


@query("threshold_check", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Needs review' WHEN c_acctbal >= 1000 THEN 'Meets' ELSE 'Does not meet' END AS verdict FROM customer")
def q_threshold(spark, d):
    rows = table(spark, d, "customer").withColumn("have", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))).withColumn("need", F.lit(1000.0))
    return compliance.threshold_check(rows, "have", "need").select("c_custkey", "verdict")


@query("unauthorised_brands", f"WITH {cte('lines', 'products')} SELECT bid_id, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM lines JOIN products USING (sku) WHERE brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1")
def q_brands(spark, d):
    rows = bound(spark, d, "lines").join(bound(spark, d, "products").select("sku", "brand", "category"), "sku")
    known = table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(F.upper("p_brand").alias("brand"))
    return compliance.unauthorised_brands(rows, known).select("bid_id", F.array_join("brands", ",").alias("brands"))


@query("standards_held", """SELECT o_custkey AS bid_id, count(*) FILTER (WHERE o_orderkey % 5 <> 2) AS held, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS missing FROM orders GROUP BY 1""")
def q_standards(spark, d):
    required = table(spark, d, "orders").select(F.col("o_custkey").alias("bid_id"), F.concat(F.lit("ISO "), (9000 + F.col("o_orderkey") % 5).cast("string")).alias("standard"))
    # every standard is held, the third with an end before the day asked for
    held = table(spark, d, "part").select(F.concat(F.lit("iso "), (9000 + F.col("p_partkey") % 5).cast("string")).alias("standard"), F.when(F.col("p_partkey") % 5 == 2, F.lit("1999-01-01").cast("date")).when(F.col("p_partkey") % 5 == 3, F.lit("2001-01-01").cast("date")).alias("valid_until"))
    found = compliance.standards_held(required, held, F.lit("2000-01-01").cast("date"))
    return found.select("bid_id", F.size("held").cast("long").alias("held"), F.size("missing").cast("long").alias("missing"))


@query("local_presence", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name IN ('NATION_3', 'NATION_4') OR r_name = 'ASIA'")
def q_presence(spark, d):
    offices = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = table(spark, d, "nation").where("n_nationkey IN (3, 4)").select(F.initcap("n_name").alias("place")).unionByName(table(spark, d, "region").where("r_name = 'ASIA'").select(F.lower("r_name").alias("place")))
    return compliance.local_presence(places, offices.select("c_custkey", F.col("r_name").alias("state"), F.col("n_name").alias("city"))).select("c_custkey", F.col("city").alias("n_name"))


@query("risk_flags", """WITH f AS (SELECT o_orderkey AS bid_id, unnest(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN {'k': 0, 'severity': 'high', 'title': 'Liability without limit'} END, CASE WHEN o_orderkey % 20 > 10 THEN {'k': 0, 'severity': 'high', 'title': 'Liquidated damages above 10 %'} END,
CASE WHEN o_orderkey % 90 > 45 THEN {'k': 1, 'severity': 'medium', 'title': 'Payment after more than 45 days'} END, CASE WHEN o_orderkey % 3 = 0 THEN {'k': 1, 'severity': 'medium', 'title': 'Reverse auction'} END, CASE WHEN o_orderkey % 30 <= 7 THEN {'k': 1, 'severity': 'medium', 'title': 'Deadline within seven days'} END,
CASE WHEN o_orderkey % 4 > 0 THEN {'k': 2, 'severity': 'low', 'title': 'Quantities may vary'} END], lambda x: x IS NOT NULL)) AS r FROM orders) SELECT bid_id, r.severity AS severity, r.title AS title FROM f""")
def q_risks(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("bid_id"), (k % 7 == 0).alias("unlimited_liability"), (k % 20).alias("ld_cap_pct"), (k % 90).alias("payment_days"), (k % 3 == 0).alias("reverse_auction"), (k % 30).alias("days_left"), (k % 4).alias("quantity_variation_pct"))
    return compliance.risk_flags(rows)


@query("document_checklist", f"""WITH {cte('lines', 'products')}, c AS (SELECT o_orderkey AS bid_id, CASE o_orderkey % 3 WHEN 0 THEN 'Turnover certificate' WHEN 1 THEN 'ISO certificate' END AS name FROM orders)
SELECT bid_id, count(DISTINCT name) AS n FROM (SELECT bid_id, name FROM c WHERE name IS NOT NULL UNION ALL SELECT bid_id, 'Manufacturer authorisation: ' || brand FROM lines JOIN products USING (sku)) GROUP BY 1""")
def q_checklist(spark, d):
    checks = table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id"), F.when(F.col("o_orderkey") % 3 == 0, "Turnover certificate").when(F.col("o_orderkey") % 3 == 1, "ISO certificate").alias("document"))
    checks = checks.unionByName(checks.withColumn("document", F.upper("document")))
    rows = bound(spark, d, "lines").join(bound(spark, d, "products").select("sku", "brand"), "sku")
    return compliance.document_checklist(checks, rows).groupBy("bid_id").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_reprice", "SELECT o_custkey % 10 AS k, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def q_incremental(spark, d):
    done = table(spark, d, "orders").select(F.col("o_orderkey").alias("bid_id"), "o_custkey", F.col("o_totalprice").alias("total"), "o_orderstatus")
    again = done.where("o_orderstatus = 'P'")
    out = compliance.incremental(done, again.select("bid_id"), again.withColumn("total", 2 * F.col("total")))
    return out.groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("compliant_alternative", f"WITH {cte('products')} SELECT s_suppkey AS row_id, min(sku) AS alternative FROM supplier JOIN products ON category = 'T' || (s_suppkey % 4) AND warranty_months >= 12 * (1 + s_suppkey % 3) GROUP BY 1")
def q_alternative(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("T"), (F.col("s_suppkey") % 4).cast("string")).alias("category"), (12 * (1 + F.col("s_suppkey") % 3)).alias("asked"))
    products = bound(spark, d, "products").select("sku", "category", F.col("warranty_months").alias("held"))
    fit = compliance.spec_fit({"warranty": F.col("asked")}, {"warranty": F.col("held")}, {"warranty": "least"})
    return compliance.compliant_alternative(rows, products, fit)


@query("spec_fit", """WITH a AS (SELECT l_partkey, l_suppkey, p_size, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_partkey % 10 AS k, count(*) AS n, round(sum((CASE WHEN p_size >= l_quantity THEN 1.0 ELSE 0.0 END + CASE WHEN l_suppkey % 4 = 0 THEN 0.0 WHEN abs(p_size - l_quantity) <= 0.5 THEN 1.0 WHEN abs(p_size - l_quantity) <= 1.5 THEN 0.6 ELSE 0.0 END
+ CASE WHEN p_size < l_quantity THEN 0.0 ELSE greatest(0.5, 1 - (p_size - l_quantity) / l_quantity) END) / CASE WHEN l_suppkey % 4 = 0 THEN 2 ELSE 3 END), 6) AS fit FROM a GROUP BY 1""")
def q_spec_fit(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w, g = F.col("l_quantity"), F.col("p_size")
    fit = compliance.spec_fit({"a": w, "b": w, "c": w, "d": F.lit(None).cast("int")}, {"a": g, "b": F.when(F.col("l_suppkey") % 4 != 0, g), "c": g, "d": g}, {"a": "least", "b": "near", "c": "power", "d": "equal"})
    return rows.groupBy((F.col("l_partkey") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(fit), 6).alias("fit"))


@query("attribute_check", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size >= 20 WHEN p_partkey % 3 = 1 THEN p_size <= 20 ELSE CASE WHEN p_partkey % 2 = 0 THEN true END END AS met FROM part""")
def q_attribute(spark, d):
    ask = F.when(F.col("p_partkey") % 3 == 0, "minimum 20 inch").when(F.col("p_partkey") % 3 == 1, "maximum 20 inch").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("type "), F.col("p_name"))).otherwise("zinc or quartz")
    return table(spark, d, "part").select("p_partkey", compliance.attribute_check(ask, F.concat_ws(" ", "p_name", "p_type"), {"inch": F.col("p_size")}).alias("met"))


@query("weighted_union", "SELECT CAST(CASE WHEN l_linenumber = 1 THEN 10 ELSE 1 END AS DOUBLE) AS weight, count(*) AS n FROM lineitem GROUP BY 1")
def q_weighted(spark, d):
    deals = bound(spark, d, "deals")
    return tender.weighted_union(deals.where("source = 'synthetic'"), deals.where("source = 'outcome'"), 10.0).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


@query("country_vote", "WITH c AS (SELECT o_custkey % 100 AS doc_id, o_orderpriority AS country, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT doc_id, arg_max(country, (n, -f)) AS country FROM c GROUP BY 1")
def q_country(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("doc_id"), F.col("o_orderpriority").alias("country"), F.col("o_orderkey").alias("pos"))
    return corpus.country_vote(rows)
