"""Fixture cases of tender extraction, evidence and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import tender


def units(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")


def test_currency_tables_and_dates(spark):
    s = spark.createDataFrame([(1, 0, "We like euros.", "US"), (1, 1, "All prices are quoted in US dollars.", "US"), (2, 0, "Budget of $ 500.", "AU"), (3, 0, "nothing", "IN")], "doc_id long, pos int, sentence string, country string")
    assert {r.doc_id: r.currency for r in tender.extract_currency(s).collect()} == {1: "USD", 2: "AUD"}
    lines = ["intro", "| Sl | Item description | Qty |", "| 1 | Laptop 14 inch | 25 Nos |", "| 2 | Mouse | 1,000 |", "| | Total | see above |", "| 9 | Ghost | 4 |"]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    assert [(r.description, r.quantity) for r in tender.extract_table_items(t).orderBy("pos").collect()] == [("Laptop 14 inch", 25), ("Mouse", 1000)]
    m = spark.createDataFrame([(1, "IN", 5, False), (1, "IN", 9, False), (1, "AE", 1, True), (2, "US", 3, False), (2, "DE", 2, False)], "doc_id long, country string, pos int, on_address boolean")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id: r.country for r in tender.resolve_location(docs, m).collect()} == {1: "AE", 2: "DE", 3: None}


def test_sections_and_links(spark):
    sections = spark.createDataFrame([(1, 1, "Delivery terms", "text"), (1, 2, "Notes", "warranty warranty warranty warranty support warranty"), (1, 3, "Blank", "")], "doc_id long, section int, title string, body string")
    lexicon = spark.createDataFrame([("delivery", "delivery", 3.0), ("warranty", "warranty", 2.0)], "kind string, word string, weight double")
    assert {r.section: r.kind for r in tender.type_sections(sections, lexicon).collect()} == {1: "delivery", 2: "warranty", 3: None}
    lines = spark.createDataFrame([(1, 1, "Laptop as per specification 5.1", "laptop"), (1, 2, "24 inch monitor", "monitor"), (1, 3, "Chair", "furniture")], "doc_id long, line_no int, description string, category string")
    specs = spark.createDataFrame([(1, "5.1", "Portable computer", "laptop"), (1, "5.2", "Monitor", "monitor")], "doc_id long, number string, title string, category string")
    assert {r.line_no: r.number for r in tender.link_specs(lines, specs).collect()} == {1: "5.1", 2: "5.2"}
    blocks = spark.createDataFrame([(1, 0, "terms", "b"), (1, 1, "scope", "a"), (1, 2, "forms", "x")], "doc_id long, pos int, kind string, text string")
    assert tender.scope_text(blocks, {"scope": 1, "terms": 2}).first().text == "a\nb"


def test_evidence_and_reports(spark):
    a = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.05)], "query_id long, section_id long, score double")
    b = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 2, 0.9)], "query_id long, sentence_id long, section_id long, score double")
    assert [(r.sentence_id, round(r.score, 3)) for r in tender.evidence(a, b).collect()] == [(10, 0.665)]
    hits = spark.createDataFrame([(0.9, "warranty for laptop batteries", "Laptop batteries carry a warranty"), (0.9, "supply of equipment", "supply of equipment"), (0.1, "warranty laptop", "warranty laptop")], "score double, query string, passage string")
    assert tender.relevant_evidence(hits).count() == 1
    rows = spark.createDataFrame([(1, 1, 0.5, 1.0, 0.9, 0.9, None, "A"), (1, 2, 0.5, 1.0, 0.9, 0.9, "b", "B"), (1, 3, 0.9, 0.0, 0.0, 0.9, "b", "C")], "query_id long, doc_id long, score double, fit double, p_category double, p_top double, brand_asked string, brand string")
    got = {r.doc_id: r.match for r in tender.match_catalogue(rows).collect()}
    assert abs(got[1] - 0.7) < 1e-9 and abs(got[2] - 0.78) < 1e-9 and got[3] < got[1]
    lines = spark.createDataFrame([(1, "software", 100, 3, 12), (1, "laptop", 5, 9, 36), (1, "mouse", 50, 2, 12)], "bid_id long, category string, quantity int, lead_time_days int, warranty_months int")
    assert [r.category for r in tender.category_scope(lines).orderBy("position").collect()] == ["mouse", "laptop", "software"]
    d = tender.delivery_extremes(lines, F.lit(True), F.lit(True)).first()
    assert (d.lead_time_days, d.warranty_months, d.completion_days) == (9, 12, 16)
    bids = spark.createDataFrame([(1, "IN", "MH", "Pune"), (2, "IN", "MH", "Pune")], "bid_id long, country string, region string, city string")
    edits = spark.createDataFrame([(1, "AE")], "bid_id long, country string")
    lines = spark.createDataFrame([(1, 1, "parser"), (1, 2, "reviewer")], "bid_id long, line_no int, origin string")
    added = spark.createDataFrame([(1, 3, "reviewer")], "bid_id long, line_no int, origin string")
    fixed, kept = tender.apply_review_edits(bids, edits, lines, added)
    assert sorted(map(tuple, fixed.collect())) == [(1, "AE", None, None), (2, "IN", "MH", "Pune")] and sorted(r.line_no for r in kept.collect()) == [1, 3]


def test_line_items_are_numbered_in_their_row(spark):
    from bidframe.operators import corpus

    docs = spark.createDataFrame([(1, "We ask.\n- 5 x laptops with 16 GB RAM\n- no number\n- twelve office chairs\n- RFQ No. 12\n"), (2, None), (3, "- Qty: 100000\n- Qty: 7")], "doc_id long, text string")
    found = corpus.extract_line_items(docs)
    assert [(r.doc_id, r.line_no, r.quantity) for r in found.orderBy("doc_id", "line_no").collect()] == [(1, 1, 5), (1, 2, 12), (3, 1, 7)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
