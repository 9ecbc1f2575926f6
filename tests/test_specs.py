"""Specification rows, clause types and evidence of the compliance matrix."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bidframe.operators import compliance, matrix, specs


def asked(spark, text, category=None):
    row = spark.createDataFrame([(text, category)], "t string, c string").select(specs.asked_specs(F.col("t"), F.col("c")).alias("x")).first().x
    return {k: v for k, v in row.asDict().items() if v is not None}


@pytest.mark.parametrize(("text", "want"), [
    ("10 x Rack server, 2x Xeon Silver, 64GB RAM, 1.92TB SSD, 27 inch", {"ram_gb": 64, "storage_gb": 1920, "storage_type": "SSD", "cpu_family": "xeon", "screen_in": 27.0}),
    ("Memory: minimum 16 GB", {"ram_gb": 16}), ("48-port PoE+ switch with 4 x 10G SFP+", {"ports": 48, "poe": True, "uplink_gbps": 10}), ("Online UPS 3kVA tower", {"capacity_va": 3000, "topology": "online", "form_factor": "tower"}),
    ("Graphics card 8 GB GDDR6 for tower", {"vram_gb": 8}), ("Core Ultra 7, 4K, Wi-Fi 6E", {"cpu_tier": 7, "resolution": "4K", "wifi": "Wi-Fi 6E"}), ("NAS, 8 bays, 2U", {"bays": 8, "form_factor": "2U"}),
    ("Firewall with 2.5 Gbps", {"throughput_gbps": 2.5}), ("Laser printer 40 ppm, 1200 dpi", {"ppm": 40, "dpi": 1200}), ("", {}), (None, {}), ("Cotton gloves", {})])
def test_asked(spark, text, want):
    assert asked(spark, text) == want


def test_component_has_no_form_factor(spark):
    assert asked(spark, "Network card for tower", "component") == {} and asked(spark, "Network card for tower", "laptop") == {"form_factor": "tower"}


PRODUCTS = [("A", {"ram_gb": "16", "screen_in": "14", "os": "Windows 11 Pro", "capacity_va": "1000", "ports": "24", "poe": "true"}, "business laptop"), ("B", {"ram_gb": "8"}, "office laptop with black lid"), ("C", None, None)]


def spec_table(spark, rows):
    reqs = spark.createDataFrame(rows, "bid_id long, line_no int, text string")
    lines = spark.createDataFrame([(1, 1, "A", "laptop"), (1, 2, "B", "laptop"), (1, 3, "C", "laptop"), (1, 4, "gone", "laptop")], "bid_id long, line_no int, sku string, category string")
    products = spark.createDataFrame(PRODUCTS, "sku string, specs map<string,string>, described string")
    return specs.spec_rows(reqs, lines, products)


def test_spec_rows(spark):
    rows = [(1, 1, "Memory: 16 GB"), (1, 2, "RAM: 16 GB"), (1, 3, "Memory: 16 GB"), (1, 4, "Memory: 16 GB"), (1, None, "Memory: 16 GB"), (1, 1, "Display: 15-inch"), (1, 1, "Power: 2 kVA"), (1, 1, "Switch: 24-port PoE"), (1, 2, "Screen: 14-inch"), (1, 1, None)]
    got = {(r.line_no, r.text): (r.fit, r.failed, r.product_os, [(f.attribute, f.finding) for f in r.findings or []]) for r in spec_table(spark, rows).collect()}
    assert got[(1, "Memory: 16 GB")] == (1.0, False, "Windows 11 Pro", [("ram_gb", "meets")]) and got[(2, "RAM: 16 GB")] == (0.0, True, "", [("ram_gb", "below")])
    assert got[(3, "Memory: 16 GB")] == (0.5, False, "", [("ram_gb", "unknown")]) and got[(4, "Memory: 16 GB")] == got[(None, "Memory: 16 GB")] == (None, False, None, [])
    assert got[(1, "Display: 15-inch")][:2] == (0.6, False) and got[(1, "Power: 2 kVA")][:2] == (0.0, True) and got[(1, "Switch: 24-port PoE")][:2] == (1.0, False)
    # a screen that the product does not state asks nothing; a null text neither
    assert got[(2, "Screen: 14-inch")] == (None, False, "", []) and got[(1, None)][0] is None
    assert spec_table(spark, []).count() == 0


def answers(spark, clauses, checks=(), held=("iso9001",), bid_held=None, long_form=True):
    """Statuses of specification and other clauses by their number."""
    rows = [(1, k, c.get("line_no"), c["text"], c["category"], c.get("type", "commercial"), c.get("strength", "mandatory"), "bidder", c.get("source", "text"), False) for k, c in enumerate(clauses)]
    reqs = spark.createDataFrame(rows, "bid_id long, req_id int, line_no int, text string, category string, type string, strength string, actor string, source string, evidenced boolean")
    lines = spark.createDataFrame([(1, 1, "A", "laptop"), (1, 2, "B", "laptop")], "bid_id long, line_no int, sku string, category string")
    reqs = specs.spec_rows(reqs, lines, spark.createDataFrame(PRODUCTS, "sku string, specs map<string,string>, described string"))
    bids = spark.createDataFrame([(1, long_form, 5, True, None, False, False, 8, True, bid_held)], "bid_id long, long_form boolean, lead_time_days int, domestic boolean, client_city string, has_office boolean, helpdesk_24x7 boolean, response_hours int, small_local boolean, held array<string>")
    said = spark.createDataFrame(list(checks), "bid_id long, check_no int, text string, verdict string")
    priced = lines.select("bid_id", "line_no", "category", F.lit(12).alias("warranty_months"), F.lit(False).alias("extended"))
    none = reqs.select("bid_id", "req_id", F.lit("x").alias("status")).limit(0)
    return {r.req_id: r.status for r in matrix.compliance_matrix(reqs, bids, priced, said, None if held is None else list(held), none).collect()}


def test_operating_system_rows(spark):
    row = lambda text, line: dict(text=text, category="technical", source="table", line_no=line)
    got = answers(spark, [row("Operating System: Windows 11 Professional", 1), row("OS: any edition", 1), row("OS: Windows 11", 2), row("Memory: 16 GB", 1), row("Memory: 16 GB", 2), row("Memory: 16 GB", None), row("Colour: black lid", 2)])
    assert got == {0: "Complies", 1: "Complies", 2: "Deviation", 3: "Complies", 4: "Deviation", 5: "Clarification required", 6: "Complies"}


def test_last_check_counts(spark):
    checks = [(1, 2, "Turnover of 3 crore", "Does not meet"), (1, 1, "TURNOVER of 3 crore", "Meets")]
    assert answers(spark, [dict(text="turnover of 3 crore", category="eligibility")], checks) == {0: "Deviation"}


def test_leftmost_payment_days(spark):
    # the earlier of the two wordings counts: the 60 days of payment, not the 30 of the invoice
    text = "Payment is made within 60 days. Claims come within 30 days of the invoice"
    assert answers(spark, [dict(text=text, category="commercial")]) == {0: "Complies with note"}


def test_clause_types(spark):
    told = dict(strength="information", text="For your information")
    clauses = [dict(told, category="warranty", type="commercial"), dict(told, category="warranty", type="scope"), dict(told, category="legal", type="commercial"), dict(told, category="legal", type=None), dict(text="Train the staff", category="scope", type="scope")]
    assert set(answers(spark, clauses)) == {0, 4} and set(answers(spark, clauses, long_form=False)) == {0, 2, 3, 4}
    rows = spark.createDataFrame([("bidder", "information", "legal", None), ("bidder", None, "legal", "scope"), (None, "mandatory", "legal", "scope")], "actor string, strength string, category string, type string")
    assert compliance.matrix_requirements(rows, F.lit(None).cast("boolean")).count() == 2


def test_standards_by_evidence(spark):
    clauses = spark.createDataFrame([(1, "ISO 9001 and ISO/IEC 27001 are needed"), (2, "GDPR applies"), (3, "No standard"), (4, None)], "bid_id long, text string")
    hits = spark.createDataFrame([(1, "iso9001", "Our ISO  9001 certificate", 1), (1, "iso27001", "Something else", 1), (1, "iso27001", "ISO/IEC 27001 audit", 2), (2, "gdpr", "We follow the GDPR", 1)], "bid_id long, standard string, passage string, rank int")
    assert {r.bid_id: r.held for r in matrix.held_by_evidence(clauses, hits).collect()} == {1: ["iso9001"], 2: ["gdpr"]}
    clause = [dict(text="ISO 9001 and ISO 27001", category="standards"), dict(text="ISO 9001", category="standards"), dict(text="RoHS", category="standards")]
    assert answers(spark, clause, held=None, bid_held=["iso9001"]) == {0: "Complies with note", 1: "Complies", 2: "Clarification required"}
    assert answers(spark, clause, held=None)[1] == "Clarification required"


def test_rows_are_spread_before_texts_are_made(spark, tmp_path):
    """One small file is one task; its rows are dealt over the shuffle partitions before their texts are read."""
    from bidframe.plans.bindings import spread

    spark.range(0, 4000, 1, 1).write.parquet(str(tmp_path / "one"))
    rows = spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert rows.rdd.getNumPartitions() == 8 and min(rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) > 0
    for name in ("matrix_thresholds", "spec_rows", "extract_line_items"):
        from __spark_entry__ import queries

        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan
