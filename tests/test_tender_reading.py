"""Tender facts, dates, award methods and criteria as documents state them."""

from __future__ import annotations

import datetime as dt

from bidframe.operators import tender_reading as reading

SCHEMA = "doc_id long, pos int, source string, text string, cells array<string>, header array<string>, kind string"


def units(spark, *rows):
    """Texts, or (cells, header) of table rows; a leading ``kind>`` names the section's kind."""
    out = []
    for pos, row in enumerate(rows):
        if isinstance(row, str):
            kind, mark, text = row.rpartition("> ")
            out.append((1, pos, "text", text, None, None, kind if mark else "notice"))
        else:
            cells, header, kind = (*row, None, "notice")[:3] if len(row) < 3 else row
            out.append((1, pos, "table", " ".join(c or "" for c in cells), cells, header, kind))
    return spark.createDataFrame(out, SCHEMA)


def test_pairs(spark):
    got = reading.labelled_pairs(units(spark, (["1.", "EMD", "Rs. 5"],), (["12", "alone"],), (["7.", "", "x"],), (["Fee", "", "Rs. 3"],), "Bid validity: 90 days", "lower case: no", "Ratio - 3:1", (["one"],))).collect()
    assert {(r.pos, r.label, r.value) for r in got} == {(0, "EMD", "Rs. 5"), (3, "Fee", "Rs. 3"), (4, "Bid validity", "90 days"), (6, "Ratio", "3:1")}


def test_facts(spark):
    u = units(
        spark, "EMD shall be Rs. 9 lakh.", (["3", "Earnest Money Deposit (EMD)", "Rs. 4,50,000 (Rupees four lakh fifty thousand only)"],), "Estimated cost of the works is Rs. 2.25 crore.",
        "Proposals shall remain valid for a period of 120 days from opening.", "Performance security of 5% of the contract value is due.",
        "Liquidated damages at 0.5% of the price per week of delay, subject to a maximum of 10% of the order.", "90% against delivery, 10% after installation.",
        "MSEs registered under Udyam are exempt from EMD.", "Preference is given under Make in India.", "Bids go through the GeM portal.", "There will be a reverse auction.", "EMD: Rs. 1 lakh")
    refs = spark.createDataFrame([(1, "GV/IT/07"), (2, None)], "doc_id long, reference string")
    got = {r.key: (r.value, r.amount) for r in reading.extract_facts(u, refs).collect()}
    assert got == {
        "reference": ("GV/IT/07", None), "emd": ("Rs. 4.50 lakh (MSEs exempt)", 450_000.0), "estimated_value": ("Rs. 2.25 crore", 22_500_000.0), "bid_validity": ("120 days", None),
        "performance_security": ("5% of contract value", 5.0), "ld": ("0.5% per week, capped at 10%", 10.0), "payment": ("90% against delivery, 10% after installation.", None),
        "msme": ("EMD/fee exemption", None), "local_content": ("Local-content preference applies", None), "submission_mode": ("GeM portal", None), "reverse_auction": ("Price discovery by reverse auction", None)}


def test_key_dates(spark):
    u = units(
        spark, "The pre-bid meeting is on 2 October 2026.", (["Pre-bid conference", "01/10/2026 at 11:00 hrs"],), "Last date for submission of bids: 20.10.2026 up to 15.00 hours", "Opening of technical bids: 20/10/2026 25:61",
        "Clarifications can be asked until 2026-09-28.", "Notice issued 5th September 2026", "Submission of bids ends 1 January 2027", "On 31/02/2026 the opening was held.")
    got = {r.key: (r.date, r.time, r.pos) for r in reading.key_dates(u).collect()}
    assert got == {
        "prebid": (dt.date(2026, 10, 1), "11:00", 1), "submission": (dt.date(2026, 10, 20), "15:00", 2), "opening": (dt.date(2026, 10, 20), None, 3),
        "queries": (dt.date(2026, 9, 28), None, 4), "publication": (dt.date(2026, 9, 5), None, 5)}
    assert reading.key_dates(units(spark, "Proposals are due on 03/04/2026."), True).first().date == dt.date(2026, 3, 4)


def test_a_date_goes_to_one_role(spark):
    """A second date of a role that is taken may serve the next role that fits."""
    u = units(spark, "Queries and submission of bids: 2026-01-01", "Queries on submission of bids: 2026-01-02", "Queries on submission of bids: 2026-01-03")
    assert {(r.key, str(r.date)) for r in reading.key_dates(u).collect()} == {("queries", "2026-01-01"), ("submission", "2026-01-02")}


def test_evaluation(spark):
    e = reading.extract_evaluation(units(
        spark, "The lowest bid won last year.", "evaluation> Weightage is 70:30 between technical and financial scores, with minimum of 60 marks.",
        (["1", "Experience", "20"], ["No", "Item", "Marks"], "evaluation"), (["2", "Staff", "n/a"], ["No", "Item", "Marks"], "evaluation"), (["3", "Price", "9"], ["No", "Item", "Note"], "evaluation"),
        "evaluation> A reverse auction may follow; the buyer may vary the quantities.")).first()
    assert (e.method, e.technical_weight, e.financial_weight, e.min_technical_score) == ("QCBS", 70.0, 30.0, 60.0)
    assert [(c.criterion, c.marks) for c in e.criteria] == [("Experience", 20.0)] and len(e.notes) == 2 and e.evidence.startswith("Weightage is 70:30")
    by = lambda text: reading.extract_evaluation(units(spark, text)).first().method
    assert [by(t) for t in ("Technical score carries 80% and the financial bid 20% weight", "The L-1 bidder gets the order", "Points are given", "Prices are firm")] == ["QCBS", "L1", "Weighted", "Not stated"]


def test_criteria(spark):
    head = ["S.No.", "Pre-qualification criteria", "Supporting documents"]
    u = units(
        spark, "eligibility> The bidder must meet the following eligibility criteria in full:", (head, head, "eligibility"),
        (["1", "The bidder shall have an average annual turnover of at least Rs. 3 crore during the last three financial years (2022-23, 2023-24, 2024-25) from supply of IT hardware.", "CA certificate"], head, "eligibility"),
        (["2", "Three similar works each costing not less than 40%, or two similar works each costing not less than 50%, or one similar work costing not less than 80% of the estimated cost in the last seven years for government bodies must be shown.", "Orders"], head, "eligibility"),
        "eligibility> The bidder should have been in operation for at least five years.", "eligibility> The OEM must hold a valid ISO 9001:2015 and ISO/IEC 27001 certificate, CMMI Level 3 as well.",
        "eligibility> The bidder must have a service centre in Pune, Mumbai or Pune within 50 km of site.", "eligibility> The bidder shall have a positive net worth of at least Rs. 50 lakh.",
        "eligibility> At least 10 certified engineers shall be on the payroll.", "eligibility> The bidder must have supplied at least 1,200 laptop computers to universities or hospitals.",
        "eligibility> The bidder shall not be blacklisted by any agency.", "eligibility> Only sober people may bid here.", "eligibility> Too short, shall go.", "The bidder shall show a turnover of Rs. 9 crore.")
    places = spark.createDataFrame([("pune", "Maharashtra"), ("mumbai", "Maharashtra"), ("goa", "Goa")], "alias string, place string")
    got = reading.extract_eligibility(u, places).orderBy("pos").collect()
    assert [r.id for r in got] == [f"EC{k:02d}" for k in range(1, 11)]
    by = {r.kind: r for r in got}
    assert list(by) == ["turnover", "similar_works", "experience_years", "certification", "local_presence", "net_worth", "engineers", "supplied_quantity", "blacklisting", "other"]
    t = by["turnover"]
    assert (t.params.amount, t.params.years, t.params.basis, t.params.financial_years, t.documents) == (30_000_000.0, 3, "average", ["2022-23", "2023-24", "2024-25"], "CA certificate")
    assert t.params.segment == "supply of IT hardware"
    w = by["similar_works"].params
    assert [(o["count"], o.pct_of_estimate) for o in w.options] == [(3, 40.0), (2, 50.0), (1, 80.0)] and w.years == 7 and "government" in w.sectors
    assert by["experience_years"].params.years == 5 and by["certification"].params.standards == ["ISO 9001", "ISO 27001", "CMMI Level 3"]
    assert by["local_presence"].places == ["Maharashtra"] and by["local_presence"].params.radius_km == 50
    assert by["net_worth"].params.positive and by["net_worth"].params.amount == 5_000_000.0 and by["engineers"].params["count"] == 10
    s = by["supplied_quantity"].params
    assert (s.quantity, s.category, s.years, s.sectors) == (1200, "laptop", 3, ["education", "healthcare"]) and s.item == "laptop computers"
    assert by["turnover"].params.options is None and by["other"].places is None


def test_no_units(spark):
    none = spark.createDataFrame([], SCHEMA)
    for found in (reading.extract_facts(none), reading.key_dates(none), reading.extract_evaluation(none), reading.extract_eligibility(none)):
        assert found.count() == 0


def test_criteria_are_written_once_before_their_parameters(spark):
    """Neither the parameters nor the places read the units or match the kinds' cues again."""
    u = units(spark, "eligibility> The firm should keep an office in Pune or within 5 km of it.")
    found = reading.extract_eligibility(u, spark.createDataFrame([("pune", "Pune")], "alias string, place string"))
    assert "blacklist|debar" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row.kind, row.places, row.params.radius_km) == ("local_presence", ["Pune"], 5)


def test_units_of_a_small_file_are_spread(spark):
    from bidframe.plans import tender_queries

    made = tender_queries._units(spark.range(100).coalesce(1), "id", tender_queries._unit("A"), tender_queries._unit("B"))
    assert made.count() == 200 and "Repartition" in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_sum_is_read_once(spark):
    units = spark.createDataFrame([(1, 0, "text", "The estimated cost is Rs. 2,500 lakh, EMD none.", None, None)], "doc_id int, pos int, source string, text string, cells array<string>, header array<string>")
    found = reading.extract_facts(units)
    assert {r.key: (r.value, r.amount) for r in found.collect()} == {"estimated_value": ("Rs. 25.00 crore", 2.5e8), "emd": ("Rs. 25.00 crore", 2.5e8)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 80
