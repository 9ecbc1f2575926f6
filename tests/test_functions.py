"""Literal cases of the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidframe.functions import scalars, text


def one(spark, builder, value):
    return spark.createDataFrame([(value,)], "x string").select(builder(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("₹1,23,456.50", 123456.5), ("Rs. 45,000/Nos", 45000.0), ("2.5 lakh", 250000.0), ("1.2 crore", 12_000_000.0), ("-", None), ("n/a", None), (None, None)])
def test_parse_amount(spark, value, want):
    assert one(spark, scalars.parse_amount, value) == want


@pytest.mark.parametrize(("value", "want"), [("3 years", 36), ("18 months", 18), ("24", 24), ("lifetime", 120), ("no warranty", 0), ("", None)])
def test_parse_months(spark, value, want):
    assert one(spark, scalars.parse_months, value) == want


@pytest.mark.parametrize(("value", "want"), [("Rs. 4,50,000 (Rupees four lakh)", 450000.0), ("Rs. 2.25 crore", 22_500_000.0), ("at least Rs. 1.5 crore each", 15_000_000.0), ("none", None)])
def test_parse_inr(spark, value, want):
    assert one(spark, scalars.parse_inr, value) == want


@pytest.mark.parametrize(("value", "want"), [("one hundred and twenty-five", 125), ("two dozen", 24), ("1,250", 1250), ("2 lakh", 200000), ("1.5k", 1500), ("an", None), ("three thousand two hundred", 3200)])
def test_number_words(spark, value, want):
    assert one(spark, scalars.parse_number_words, value) == want


@pytest.mark.parametrize(("value", "want"), [("2026-10-05", dt.date(2026, 10, 5)), ("05/10/2026", dt.date(2026, 10, 5)), ("5 Oct 2026", dt.date(2026, 10, 5)), ("2026-10-05T10:00:00", dt.date(2026, 10, 5)), ("never", None)])
def test_dates(spark, value, want):
    assert one(spark, scalars.parse_date_multi, value) == want


def test_tokens(spark):
    got = one(spark, text.tokens, "16GB RAM, ISO/IEC 27001 and Wi-Fi 6")
    assert {"16", "gb", "iso", "iec", "27001", "wi-fi", "wi", "fi"} <= set(got) and "and" not in got


def test_sentences(spark):
    assert one(spark, text.sentences, "Scope. We need laptops.\n- 20 monitors\n- 5 switches") == ["Scope.", "We need laptops.", "20 monitors", "5 switches"]


@pytest.mark.parametrize(("value", "strength", "actor"), [
    ("The bidder must hold ISO 9001.", "mandatory", "bidder"), ("Consortium bids are not permitted.", "mandatory", "bidder"),
    ("The Purchaser reserves the right to reject.", "information", "buyer"), ("Preference will be given to local makers.", "desirable", "bidder"),
    ("Deliveries should arrive before noon.", "mandatory", "bidder"), ("4.2 University shall make payment within 30 days.", "mandatory", "buyer"), ("The Purchaser shall pay the bidder.", "mandatory", "bidder"),
    ("The buyer's forms must be used.", "mandatory", "bidder"), ("Vendors may also offer a longer term.", "desirable", "bidder"), ("The bidder may visit.", "information", "bidder"), ("No advance shall be paid", "mandatory", "bidder")])
def test_modality(spark, value, strength, actor):
    got = one(spark, text.modality, value)
    assert (got.strength, got.actor) == (strength, actor)


def test_warranty_by_category(spark):
    got = one(spark, text.warranty_by_category, "Graphics cards carry three years and UPS units two years of warranty. Keyboards, mice and webcams one year, headsets one year.")
    assert got == {"component": 36, "power": 24, "peripheral": 12, "audio": 12}


def test_stem_and_fold(spark):
    assert [one(spark, text.stem, w) for w in ("shipping", "planned", "policies", "class", "organization", "16gb", "boxes")] == ["ship", "plan", "policy", "class", "organize", "16gb", "box"]
    assert one(spark, text.fold, "Präzision ÉTÉ") == "prazision ete" == one(spark, text.fold_full, "Präzision ÉTÉ")


def test_money_and_small_functions(spark):
    row = spark.range(1).select(
        scalars.round_money(F.lit(10.555), F.lit("JPY")).alias("jpy"), scalars.round_money(F.lit(10.5555), F.lit("KWD")).alias("kwd"), scalars.round_money(F.lit(10.555), F.lit("INR")).alias("inr"),
        scalars.volume_discount(F.lit(120)).alias("v"), scalars.price_sensitivity(F.lit(100.0)).alias("s"), scalars.hsn_valid(F.lit("8518.30")).alias("h"), scalars.gst_slab_valid(F.lit(17.0)).alias("g"),
        scalars.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), text.same_segment(F.lit("Supply of computer hardware"), F.lit("IT hardware supply")).alias("same")).first()
    assert (row.jpy, row.kwd, row.inr, row.v, row.s, row.h, row.g) == (11.0, 10.556, 10.56, 4.5, 2.0, True, False)
    assert row.j == pytest.approx(1 / 3) and row.same
    assert one(spark, text.line_shape, "  Page 12   of 30 ") == "page # of #"
    assert one(spark, scalars.slug, "  Acme & Sons (Pvt.) ") == "acme_sons_pvt"
    assert one(spark, lambda x: text.dehyphenate(F.split(x, "\n")), "inter-\nnational trade\nX") == "international trade X"


@pytest.mark.parametrize(("value", "kind", "clause_type", "confidence", "long", "want"), [
    ("EMD of 2 %", "eligibility", "payment", 0.9, True, "eligibility"), ("EMD of 2 %", "eligibility", "payment", 0.9, False, "commercial"), ("ISO 9001 certification", "notice", None, 0.1, True, "standards"),
    ("Complaints are resolved within 24 hours", None, None, 0.0, True, "warranty"), ("Anything else", "conditions", "scope", 0.9, True, "legal"), ("Delivery at site", None, "delivery", 0.2, False, "delivery"),
    ("Delivery at site", None, "payment", 0.5, False, "commercial"), ("Words", None, "other", 0.5, False, "scope"), ("Words", None, "compliance", 0.44, False, "scope")])
def test_clause_category(spark, value, kind, clause_type, confidence, long, want):
    row = spark.createDataFrame([(value, kind, clause_type, confidence, long)], "s string, kind string, type string, confidence double, long boolean")
    assert row.select(text.clause_category(F.col("s"), F.col("kind"), F.col("type"), F.col("confidence"), F.col("long")).alias("y")).first().y == want


@pytest.mark.parametrize(("asked", "held", "want"), [
    ("ICT system integration", "system integration", True), ("sale of products", "trading", True), ("network cabling", "network printing", False), ("technology equipment", "computers", False)])
def test_same_segment(spark, asked, held, want):
    row = spark.createDataFrame([(asked, held)], "a string, b string")
    assert row.select(text.same_segment(F.col("a"), F.col("b")).alias("y")).first().y is want


def test_normalize(spark):
    assert one(spark, text.normalize, " \u201cA\u201d \u2013 2\u00d73  \u00bd   col\t x \n  y\u00a0z ") == "\"A\" - 2x3 1\u20442\tcol\tx\ny z"


@pytest.mark.parametrize(("name", "body", "want"), [("Delhi University", "hospital", "education"), ("Acme Ltd", "The hospital asks", "healthcare"), ("Group of five", None, "enterprise"), ("Acme", "nothing", "smb"), (None, "a smart city", "public")])
def test_infer_segment(spark, name, body, want):
    from bidframe.operators.corpus import infer_segment

    row = spark.createDataFrame([(name, body)], "n string, t string")
    assert row.select(infer_segment(F.col("n"), F.col("t")).alias("y")).first().y == want


def test_content_digest(spark):
    from bidframe.operators.corpus import content_digest

    a = spark.createDataFrame([(1, "x"), (1, "y" * 50 + "1"), (2, "y" * 50 + "2"), (2, "x"), (3, "y" * 50 + "1"), (3, "x"), (4, None)], "k long, text string")
    got = {r.k: r.digest for r in content_digest(a, ["k"]).collect()}
    assert got[1] == got[3] != got[2] and len(got) == 4
