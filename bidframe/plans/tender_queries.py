"""Registered queries of tender facts, dates, award methods and criteria; numbers and dates in the texts come from columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidframe.functions import tables
from bidframe.operators import tender_reading as reading
from bidframe.plans.bindings import table
from bidframe.plans.queries import query


def _s(x: Column | str | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def _say(*parts) -> Column:
    return F.concat(*map(_s, parts))


def _unit(text, source: str = "text", cells=None, header=None, kind: str = "notice") -> Column:
    array = lambda xs: F.lit(None).cast("array<string>") if xs is None else F.array(*map(_s, xs))
    return F.struct(F.lit(source).alias("source"), _s(text).alias("text"), array(cells).alias("cells"), array(header).alias("header"), F.lit(kind).alias("kind"))


def _units(rows, key: str, *units: Column):
    """Units of each row; a small file of many rows is one task until its rows are spread, and the texts made from it are large."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.select(F.col(key).alias("doc_id"), F.posexplode(F.array_compact(F.array(*units))).alias("pos", "u")).select("doc_id", "pos", "u.*")


@query("extract_facts", """WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 2 = 0 AS spared FROM part),
f AS (SELECT p_partkey AS doc_id, unnest([
  {'key': 'emd', 'value': CASE WHEN spared THEN 'Rs. ' || printf('%.2f', n::DOUBLE) || ' lakh (MSEs exempt)' ELSE 'Rs. ' || n || ' lakh' END, 'amount': n * 1e5},
  {'key': 'bid_validity', 'value': n || ' days', 'amount': NULL}, {'key': 'performance_security', 'value': (1 + n % 9) || '% of contract value', 'amount': 1.0 + n % 9},
  {'key': 'ld', 'value': '0.5% per week, capped at ' || (5 + n % 9) || '%', 'amount': 5.0 + n % 9}, {'key': 'msme', 'value': CASE WHEN spared THEN 'EMD/fee exemption' ELSE 'Purchase preference' END, 'amount': NULL},
  {'key': 'estimated_value', 'value': 'Rs. ' || printf('%.2f', n::DOUBLE) || ' crore', 'amount': n * 1e7}, {'key': 'submission_mode', 'value': 'Online through the GeM portal', 'amount': NULL}]) AS f FROM p)
SELECT doc_id, f.key AS key, f.value AS value, f.amount::DOUBLE AS amount FROM f""")
def q_facts(spark, d):
    n = F.col("p_size")
    benefit = F.when(F.col("p_partkey") % 2 == 0, "Micro and small firms are exempt from it.").otherwise("MSEs enjoy a purchase preference.")
    units = _units(
        table(spark, d, "part"), "p_partkey", _unit("", "table", [7, "Earnest Money Deposit", _say("Rs. ", n, " lakh")]), _unit(_say("Bid validity: ", n, " days")),
        _unit(_say("The performance security shall be ", 1 + n % 9, "% of the contract value.")), _unit(_say("Liquidated damages of 0.5% per week apply, up to a maximum of ", 5 + n % 9, "% of the price.")),
        _unit(benefit), _unit(_say("The estimated cost of this work is Rs. ", n, " crore.")), _unit("An EMD of Rs. 9 lakh was asked last year."), _unit("Bids shall remain valid for 90 days."),
        _unit("Bids go in online through the GeM portal, not on paper."), _unit("Table", "table", ["12", "Bid validity: 1 day"]))
    return reading.extract_facts(units).select("doc_id", "key", "value", "amount")


@query("key_dates", """SELECT o_orderkey AS doc_id, unnest(['queries', 'prebid', 'opening', 'submission', 'publication']) AS key,
unnest([o_orderdate::DATE + 2, o_orderdate::DATE + 3, o_orderdate::DATE + 31, o_orderdate::DATE + 30, o_orderdate::DATE]) AS date,
unnest([NULL, '11:00', printf('%02d:05', o_orderkey % 24), '15:30', NULL]) AS time FROM orders""")
def q_key_dates(spark, d):
    at = lambda days, layout: F.date_format(F.date_add(F.to_date("o_orderdate"), days), layout)
    units = _units(
        table(spark, d, "orders"), "o_orderkey", _unit("", "table", ["Pre-bid meeting", _say(at(3, "dd/MM/yyyy"), " at 11:00 hrs")]), _unit(_say("Last date of submission of bids: ", at(30, "dd.MM.yyyy"), " 15:30")),
        _unit(_say("This tender was published on ", at(0, "d MMMM yyyy"), ".")), _unit(_say("The bid opening will be on ", at(31, "yyyy-MM-dd"), " at ", F.col("o_orderkey") % 24, ".05 hours")),
        _unit(_say("Queries may be sent until ", at(2, "MMM d, yyyy"), ".")), _unit(_say("Submission of bids closes on ", at(60, "yyyy-MM-dd"), ".")), _unit("On 31/02/2024 nothing opens."))
    return reading.key_dates(units).select("doc_id", "key", "date", "time")


@query("extract_evaluation", """SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'QCBS' WHEN 1 THEN 'L1' WHEN 2 THEN 'Weighted' ELSE 'Not stated' END AS method,
CASE WHEN p_partkey % 4 = 0 THEN 50.0 + p_size % 40 END::DOUBLE AS technical_weight, CASE WHEN p_partkey % 4 = 0 THEN 50.0 - p_size % 40 END::DOUBLE AS financial_weight,
CASE WHEN p_partkey % 4 = 0 THEN 60.0 + p_size % 30 END::DOUBLE AS min_technical_score, CASE WHEN p_partkey % 4 = 2 THEN p_size + 30.0 ELSE 0.0 END::DOUBLE AS marks, (p_partkey % 4 = 1)::BIGINT AS notes FROM part""")
def q_evaluation(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    own = lambda *a, **b: _unit(*a, kind="evaluation", **b)
    marks = lambda name, m: F.when(k == 2, own("", source="table", cells=[name, "", m], header=["Criterion", "Remark", "Marks"]))
    units = _units(
        table(spark, d, "part"), "p_partkey", F.when(k < 3, _unit("Last year the lowest bid won by QCBS.")),
        F.when(k == 0, own(_say("Scores combine in the ratio ", 50 + n % 40, ":", 50 - n % 40, " of technical and financial bids. A qualifying score of ", 60 + n % 30, " is needed."))),
        F.when(k == 1, own("The lowest evaluated bid wins after a reverse auction.")), F.when(k == 2, own("Bids get marks by this table.")), marks("Experience", n), marks("Staff", 30), marks("Notes", "see above"),
        F.when(k == 3, _unit("Nothing is said about the choice.")))
    total = F.aggregate("criteria", F.lit(0.0), lambda a, x: a + x["marks"]).alias("marks")
    return reading.extract_evaluation(units).select("doc_id", "method", "technical_weight", "financial_weight", "min_technical_score", total, F.size("notes").cast("long").alias("notes"))


@query("extract_eligibility", """WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, n_name FROM part JOIN nation ON n_nationkey = p_size % 25)
SELECT doc_id, 'EC01' AS id, 'turnover' AS kind, n * 1e7 AS amount, 3 AS years, '2022-23,2023-24' AS said, NULL AS number, NULL AS documents FROM p
UNION ALL SELECT doc_id, 'EC02', 'similar_works', NULL, 7, '3,2,1', 40.0 + 50 + (30 + n), NULL FROM p
UNION ALL SELECT doc_id, 'EC03', 'certification', NULL, NULL, 'ISO 9001,CMMI Level ' || (1 + n % 5), NULL, 'Copies' FROM p
UNION ALL SELECT doc_id, 'EC04', 'local_presence', NULL, NULL, n_name, n, NULL FROM p
UNION ALL SELECT doc_id, 'EC05', 'experience_years', NULL, 3 + n % 5, NULL, NULL, NULL FROM p
UNION ALL SELECT doc_id, 'EC06', 'supplied_quantity', NULL, 5, 'laptop,education', 1000.0 + n, NULL FROM p
UNION ALL SELECT doc_id, 'EC07', 'other', NULL, NULL, NULL, NULL, NULL FROM p""")
def q_eligibility(spark, d):
    n = F.col("p_size")
    parts = table(spark, d, "part").join(table(spark, d, "nation"), F.col("n_nationkey") == n % 25)
    own = lambda *a, **b: _unit(*a, kind="eligibility", **b)
    head = ["S.No", "Eligibility criteria", "Documents to be submitted"]
    years = F.get(F.array(*map(F.lit, ("three", "four", "five", "six", "seven"))), (n % 5).cast("int"))
    units = _units(
        parts, "p_partkey", own("The bidder shall meet the following eligibility criteria of this tender:"),
        own(_say("The bidder shall have an average annual turnover of at least Rs. ", n, " crore in the last three financial years (2022-23, 2023-24).")),
        own(_say("It must have done three similar works each costing not less than 40% or two works costing at least 50% or one work costing at least ", 30 + n, "% of the estimate.")),
        own("", source="table", cells=head, header=head), own("", source="table", cells=["1", _say("The bidder must hold valid ISO 9001:2015 and CMMI Level ", 1 + n % 5, " papers"), "Copies"], header=head),
        own(_say("The firm should keep an office in ", F.col("n_name"), " or within ", n, " km of it.")), own(_say("The bidder should be in operation for at least ", years, " years.")),
        own(_say("The bidder must have supplied at least 1,0", F.lpad(n.cast("string"), 2, "0"), " notebook units to any university in the last five years.")),
        own("Only firms with a clean record may bid here."), own("Nice weather."), _unit("The turnover shall be at least Rs. 1 crore."))
    places = table(spark, d, "nation").select(F.lower(F.translate("n_name", "_", " ")).alias("alias"), F.col("n_name").alias("place"))
    p = F.col("params")
    counts = F.array_join(F.transform(p["options"], lambda o: o["count"].cast("string")), ",")
    said = F.coalesce(F.array_join(F.transform(p["financial_years"], lambda y: y), ","), counts, F.array_join(p["standards"], ","), F.array_join("places", ","), F.concat_ws(",", p["category"], F.array_join(p["sectors"], ",")))
    number = F.coalesce(F.aggregate(p["options"], F.lit(0.0), lambda a, o: a + o["pct_of_estimate"]), p["radius_km"].cast("double"), p["quantity"].cast("double"))
    return reading.extract_eligibility(units, places).select("doc_id", "id", "kind", p["amount"].alias("amount"), p["years"].alias("years"), F.nullif(said, F.lit("")).alias("said"), number.alias("number"), "documents")


@query("table_function_dates", "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders, (VALUES (1), (2), (3), (4)) v(i) GROUP BY 1, 2")
def q_date_function(spark, d):
    at = lambda f: F.date_format("o_orderdate", f)
    text = _say("Due ", at("yyyy-MM-dd"), " or ", at("d MMM yyyy"), ", that is ", at("MMMM d, yyyy"), " (", at("dd/MM/yyyy"), "), not 45/45/2020.")
    tables.register(spark)
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return spark.sql("SELECT d.doc_id, t.date, count(*) AS n FROM {docs} d, LATERAL find_dates(d.text, false) t GROUP BY d.doc_id, t.date", docs=docs)


@query("table_function_places", "SELECT p_partkey AS doc_id, unnest([n_name, 'inside ' || n_name]) AS place, 1::BIGINT AS n FROM part JOIN nation ON n_nationkey = p_size % 25")
def q_place_function(spark, d):
    """The longer alias hides the short one inside it; a short one that stands alone is found."""
    short = F.lower(F.translate("n_name", "_", ""))
    names = table(spark, d, "nation").select(F.concat(F.lit("land of "), short).alias("alias"), F.col("n_name").alias("place"))
    inner = table(spark, d, "nation").select(short.alias("alias"), F.concat(F.lit("inside "), F.col("n_name")).alias("place"))
    number = F.col("p_size") % 25
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), _say("Goods for the Land of Nation", number, ", by ship from nation", number).alias("text"))
    return tables.places_of(docs, names.unionByName(inner)).groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n"))
