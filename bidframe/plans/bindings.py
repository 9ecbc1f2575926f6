"""The driver's tables seen as the domain's: each binding as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidframe.operators.joins import dealt, small

#: Even percentages: list prices have one decimal, so no tiered price lies half-way between two cents.
TIERS = [("*", 10, 2.0), ("*", 25, 4.0), ("*", 40, 6.0), ("T0", 20, 2.0), ("T0", 45, 8.0), ("T1", 30, 4.0)]
VALUE_ADDS = [
    ("WTY-EXT12", "warranty", "percent", 2.8, 7.5, 12), ("WTY-EXT24", "warranty", "percent", 5.0, 12.5, 24), ("SVC-DEPLOY", "service", "flat", 35.0, 90.0, 0),
    ("SVC-SPARES", "support", "percent", 2.0, 6.0, 0), ("TRN-LAB", "training", "flat", 50.0, 250.0, 0),
]
FX = [("INR", 1.0), ("USD", 1 / 88.2), ("EUR", 1 / 103.1), ("JPY", 1 / 0.593), ("KWD", 1 / 288.6), ("AED", 1 / 24.02)]
CURRENCIES = ["INR", "USD", "EUR", "JPY", "KWD", "AED", "XXX"]
TAX_RULES = [
    (1, "IN", None, "*", "GST", 18.0), (2, "IN", None, "software", "GST", 18.0), (3, "US", "North", "goods", "State sales tax", 7.25), (4, "US", None, "*", "Sales tax", 0.0),
    (5, "AE", None, "*", "VAT", 5.0), (6, "DE", None, "*", "MwSt", 19.0), (7, "DE", None, "*", "MwSt old", 16.0), (8, "CA", "North", "*", "QST", 14.975), (9, "CA", None, "goods", "GST", 5.0),
]
COUNTRIES = ["IN", "US", "AE", "DE", "CA", "ZZ"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PRODUCTS = """SELECT p_partkey AS sku, p_partkey AS mpn, p_name AS name, 'T' || CAST(p_partkey % 4 AS STRING) AS category, p_brand AS brand, p_type AS type,
  p_retailprice AS list_price, 0.8 * p_retailprice AS unit_cost, CAST(8.0 AS DOUBLE) AS min_margin_pct, CAST(3 + p_size % 10 AS INT) AS lead_time_days,
  CAST(12 * (1 + p_size % 3) AS INT) AS warranty_months, CAST(10 * (p_size % 7) AS INT) AS stock_qty, p_partkey % 17 <> 0 AS active FROM part"""
SEGMENT = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'enterprise' WHEN 'BUILDING' THEN 'smb' WHEN 'FURNITURE' THEN 'public' WHEN 'MACHINERY' THEN 'education' ELSE 'healthcare' END"
BIDS = f"""SELECT o_orderkey AS bid_id, c_name AS client, 'REF-' || CAST(o_orderkey AS STRING) AS reference, {SEGMENT} AS segment, n_name AS country, CAST(o_custkey AS BIGINT) AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'review' ELSE 'rejected' END AS status, CAST(o_orderdate AS DATE) AS bid_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS due_date, o_totalprice AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN 'L1' WHEN o_orderkey % 3 = 1 THEN 'QCBS' ELSE 'Weighted' END AS award, c_custkey % 4 = 0 AS repeat_customer, o_orderkey % 2 = 0 AS mse
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
LINES = """SELECT l_orderkey AS bid_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS line_no,
  l_partkey AS sku, CAST(l_quantity AS INT) AS quantity, CAST(l_shipdate AS DATE) AS shipped, l_suppkey AS supplier_id, l_returnflag AS flag, l_discount AS discount FROM lineitem"""
OBSERVATIONS = """SELECT l_partkey AS mpn, l_suppkey AS competitor_id, CAST(l_shipdate AS DATE) AS observed_on, p_brand AS brand, p_retailprice * (0.70 + 0.006 * ((31 * l_partkey + 17 * l_suppkey) % 100)) AS unit_price,
  CASE l_suppkey % 4 WHEN 0 THEN 'quotes' WHEN 1 THEN 'awards' WHEN 2 THEN 'web' ELSE 'other' END AS adapter, l_orderkey AS source_order, l_linenumber AS source_line
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
COMPETITORS = "SELECT s_suppkey AS id, s_name AS name, 0.55 + (s_suppkey % 45) / 100.0 AS reliability, CAST(5 + s_suppkey % 9 AS INT) AS lead_low, CAST(14 + s_suppkey % 11 AS INT) AS lead_high, CAST(12 * (1 + s_suppkey % 3) AS INT) AS default_warranty_months FROM supplier"
RUNS = """SELECT event_id, event_type AS stage, user_id AS key, ts AS started_at, ts + INTERVAL '1' SECOND * CAST(floor(coalesce(value, 0)) AS INT) AS finished_at,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type <> 'error' AS completed FROM events"""
DEALS = f"""SELECT l_orderkey * 10 + l_linenumber AS deal_id, l_orderkey AS rfp_id, {SEGMENT} AS segment, 'T' || CAST(l_partkey % 4 AS STRING) AS category, CAST(l_shipdate AS DATE) AS closed_on, 0.6 + ((l_partkey * 7 + l_suppkey * 3) % 100) / 100.0 AS price_ratio,
  CAST(l_partkey % 61 - 30 AS INT) AS warranty_delta_months, CAST(l_suppkey % 51 - 25 AS INT) AS lead_time_delta_days, l_partkey % 3 = 0 AS bundled_value_add, c_custkey % 4 = 0 AS repeat_customer,
  l_returnflag <> 'R' AS won, CASE WHEN l_linenumber = 1 THEN 'outcome' ELSE 'synthetic' END AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

_BOUND = {"products": PRODUCTS, "bids": BIDS, "lines": LINES, "observations": OBSERVATIONS, "competitors": COMPETITORS, "runs": RUNS, "deals": DEALS}
_SOURCES = {"products": ["part"], "bids": ["orders", "customer", "nation"], "lines": ["lineitem"], "observations": ["lineitem", "part"], "competitors": ["supplier"], "runs": ["events"], "deals": ["lineitem", "orders", "customer"]}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's files; SQL arguments stand for the tables, no view is left behind."""
    tables = {t: table(spark, sf_dir, t) for t in _SOURCES[name]}
    if name == "deals" and (total := tables["lineitem"].count()) > 8_000_000:  # both sides are sorted: a task's part must not grow with the tables
        tables["lineitem"], tables["orders"] = dealt(tables["lineitem"], "l_orderkey", total), dealt(tables["orders"], "o_orderkey", total)
    return spark.sql(_named(_BOUND[name], _SOURCES[name]), **tables)


def _named(sql: str, names: list[str]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return sql


def cte(*names: str) -> str:
    """The same tables as common table expressions for DuckDB."""
    return ", ".join(f"{n} AS ({_BOUND[n].replace('AS STRING', 'AS VARCHAR')})" for n in names)


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "category string, min_qty int, discount_pct double")


def value_adds(spark: SparkSession) -> DataFrame:
    rows = [(*v, ["T0", "T1", "T2"] if v[0] != "WTY-EXT24" else ["T0", "T3"]) for v in VALUE_ADDS]
    return spark.createDataFrame(rows, "code string, kind string, basis string, cost_rate double, value_rate double, warranty_extension_months int, categories array<string>")


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FX, "currency string, rate double")


def tax_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAX_RULES, "rule_no int, country string, region string, tax_category string, name string, rate_pct double")


def values(rows: list[tuple], columns: str, name: str) -> str:
    """A literal table as a common table expression."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)})"


def priced_lines(spark: SparkSession, sf_dir: str, regrouped: bool = True) -> DataFrame:
    """Bid lines with product, buyer and one rival's offer: the input of the price search.

    Lines are numbered by bid. They meet their bid first where they need not
    lie by bid in the end (``regrouped``), so they carry few columns when
    they move, and a small table of rivals does not move them.
    """
    from bidframe.operators.costing import cost_bid_lines

    lines = bound(spark, sf_dir, "lines").select("bid_id", "line_no", "sku", "quantity", "supplier_id")
    bids = bound(spark, sf_dir, "bids").select("bid_id", "segment", "award", "repeat_customer")
    rival = bound(spark, sf_dir, "competitors").select(F.col("id").alias("supplier_id"), F.col("lead_high").alias("best_lead"), F.col("default_warranty_months").alias("best_warranty"))
    weight = F.when(F.col("award") == "L1", 100.0).otherwise(50.0)
    best = F.col("list_price") * (0.70 + 0.006 * ((31 * F.col("sku") + 17 * F.col("supplier_id")) % 100))
    costed = cost_bid_lines(lines if regrouped else lines.join(bids, "bid_id"), bound(spark, sf_dir, "products"), tiers(spark))
    # by bid last, so that what follows for each bid finds its lines together
    rows = costed.join(rival, "supplier_id").join(bids, "bid_id") if regrouped else costed.join(small(rival, 1_000_000), "supplier_id")
    return rows.withColumn("price_weight", weight).withColumn("best_price", best)


def first_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy("bid_id").orderBy("line_no"))).where("_n = 1").drop("_n")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over the shuffle partitions: a small file of many rows is one task until they are, and the texts made from a row are large."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
