"""Readers, imports, and streams against their batch results."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bidframe.sources import imports, tabular
from bidframe.streaming import queries as streams


def test_delimited_files_find_their_own_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Price list;;\n\nItem;Unit Cost;Qty\n Mouse ;\"1;5\";2\n;;\n")
    (tmp_path / "b.csv").write_text("item|cost\nCable|3\n")
    rows = tabular.read_delimited(spark, str(tmp_path))
    heads = tabular.detect_header(rows)
    got = tabular.map_headers(rows, heads, {"name": ["item", "product"], "unit_cost": ["unit cost", "cost"], "quantity": ["qty"]})
    assert sorted((r.name, r.unit_cost, r.quantity) for r in got.collect()) == [("Cable", "3", None), ("Mouse", "1;5", "2")]


def test_stock_xml(spark, tmp_path):
    path = tmp_path / "stock.xml"
    path.write_text("""<ENVELOPE><STOCKITEM NAME="Headset"><BASEUNITS>Nos</BASEUNITS><OPENINGBALANCE>120 Nos</OPENINGBALANCE><OPENINGRATE>310/Nos</OPENINGRATE><STANDARDPRICE>449/Nos</STANDARDPRICE><HSNCODE>85183000</HSNCODE>
<GSTDETAILS.LIST><RATEDETAILS><GSTRATEDUTYHEAD>Central Tax</GSTRATEDUTYHEAD><GSTRATE>9</GSTRATE></RATEDETAILS><RATEDETAILS><GSTRATEDUTYHEAD>Integrated Tax</GSTRATEDUTYHEAD><GSTRATE>18</GSTRATE></RATEDETAILS></GSTDETAILS.LIST></STOCKITEM></ENVELOPE>""")
    (r,) = tabular.read_stock_xml(spark, str(path)).collect()
    assert (r.name, r.stock, r.cost, r.gst_rate_pct) == ("Headset", "120 Nos", "310/Nos", 18.0)
    path.write_text('<!DOCTYPE x [<!ENTITY a "b">]><ENVELOPE/>')
    with pytest.raises(ValueError):
        tabular.read_stock_xml(spark, str(path))


def test_a_markdown_text_does_not_go_along_with_its_sections(spark, tmp_path):
    (tmp_path / "many.md").write_text("# Guide\n" + "".join(f"## S{i}\nbody {i}\n" for i in range(500)))
    found = tabular.read_markdown_sections(spark, str(tmp_path / "many.md"))
    assert sorted((r.title, r.pos, r.heading, r.body) for r in found.collect()) == [("Guide", i + 1, f"S{i}", f"body {i}") for i in range(500)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_extract")  # below it: once a file, not once a section


def test_json_markdown_and_text(spark, tmp_path):
    (tmp_path / "tiers.json").write_text(json.dumps({"*": [{"min_qty": 10, "discount_pct": 2}], "a": [{"min_qty": 5, "discount_pct": 1.5}]}))
    assert sorted(map(tuple, tabular.read_tiers(spark, str(tmp_path / "tiers.json")).collect())) == [("*", 10, 2.0), ("a", 5, 1.5)]
    (tmp_path / "k.md").write_text("# Guide\nintro\n## One\nfirst body\n## Two\nsecond\n")
    assert [(r.title, r.heading, r.body) for r in tabular.read_markdown_sections(spark, str(tmp_path / "k.md")).orderBy("pos").collect()] == [("Guide", "One", "first body"), ("Guide", "Two", "second")]
    texts = tmp_path / "t"
    texts.mkdir()
    (texts / "1.txt").write_bytes("é".encode())
    (texts / "2.txt").write_bytes("é“".encode("cp1252"))
    (texts / "3.txt").write_bytes("é".encode("utf-16"))
    assert sorted(r.text for r in tabular.read_text_documents(spark, str(texts)).collect()) == ["é", "é", "é“"]


def test_page_prices(spark):
    pages = spark.createDataFrame([
        (1, '<title>T</title><script type="application/ld+json">{"@type":"Product","name":"Dock","offers":{"price":"12499.00","priceCurrency":"INR"}}</script>'),
        (2, '<title>Mouse</title><meta property="product:price:amount" content="71,900">'), (3, "<title>X</title><p>Deal price: ₹ 6,495</p>"), (4, "<p>nothing</p>")], "page_id long, html string")
    got = {r.page_id: (r.name, r.price, r.source) for r in tabular.extract_page_prices(pages).collect()}
    assert got == {1: ("Dock", 12499.0, "schema.org offer"), 2: ("Mouse", 71900.0, "price meta tag"), 3: ("X", 6495.0, "visible text"), 4: (None, None, None)}


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "obs")
    tabular.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "x int, adapter string"), path, "adapter")
    tabular.replace_partition(spark.createDataFrame([(9, "a")], "x int, adapter string"), path, "adapter")
    assert sorted((r.x, r.adapter) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]


def test_import_plan_and_commit(spark):
    products = spark.createDataFrame([("S1", "M1", "Old mouse", "peripheral", 2000.0, 2650.0, 5, 1), ("S2", "M2", "Cable", "x", 10.0, 20.0, 9, 2)], "sku string, mpn string, name string, category string, unit_cost double, list_price double, stock_qty int, product_no long")
    rows = spark.createDataFrame([(1, "s1", None, "New name", None, None, 2500.0, None, None, None), (2, None, None, "USB headset", None, 100.0, None, 3, "85183000", 18.0), (3, None, None, None, None, None, 5.0, None, None, None),
                                  (4, None, "m1", None, None, None, 2400.0, None, None, None), (5, "S2", None, None, None, 10.0, 20.0, 9, "123", 17.0)],
                                 "row_no int, sku string, mpn string, name string, category string, unit_cost double, list_price double, stock_qty int, hsn string, gst_rate_pct double")
    plan = imports.import_plan(rows, products)
    got = {r.row_no: r for r in plan.collect()}
    assert [got[k].action for k in (1, 2, 3, 4, 5)] == ["update", "create", "skip", "skip", "unchanged"]
    assert [(c.field, c.old, c.new) for c in got[1].changes] == [("list_price", 2650.0, 2500.0)]
    assert (got[2].category, got[2].list_price) == ("audio", 115.0) and got[5].issues == ["HSN of odd length", "no tax slab"]
    counts = imports.plan_counts(plan).first()
    assert (counts.create, counts.update, counts.unchanged, counts.skip) == (1, 1, 1, 2)
    catalogue, versions = imports.import_commit(plan.withColumn("sku", F.coalesce("sku", F.lit("NEW"))), products, F.current_timestamp())
    assert {(r.sku, r.name, r.list_price) for r in catalogue.collect()} == {("S1", "Old mouse", 2500.0), ("S2", "Cable", 20.0), ("NEW", "USB headset", 115.0)} and versions.count() == 2


T0 = dt.datetime(2026, 1, 1)


def run(spark, tmp_path, batches, schema, build, mode, name):
    """Feed batches of rows as files, one a trigger, and return what the stream wrote."""
    source = tmp_path / f"in-{name}"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_freshest_price_stream(spark, tmp_path):
    schema = "mpn long, competitor_id long, observed_on timestamp, unit_price double"
    batches = [[(1, 1, T0, 10.0), (1, 2, T0, 5.0)], [(1, 1, T0 - dt.timedelta(days=3), 99.0)], [(1, 1, T0 + dt.timedelta(days=1), 11.0)]]
    rows = run(spark, tmp_path, batches, schema, streams.freshest_price, "update", "fresh")
    final = {}
    for r in rows:
        if (r.mpn, r.competitor_id) not in final or r.observed_on > final[r.mpn, r.competitor_id][0]:
            final[r.mpn, r.competitor_id] = (r.observed_on, r.unit_price)
    assert {k: v[1] for k, v in final.items()} == {(1, 1): 11.0, (1, 2): 5.0} and len(rows) == 3


def test_alert_throttle_and_trigger_streams(spark, tmp_path):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    alerts = run(spark, tmp_path, [[(1, s(0), 100.0)], [(1, s(1), 130.0), (1, s(2), 131.0)]], "sku long, effective_from timestamp, unit_price double", streams.price_alerts, "append", "alerts")
    assert [(r.sku, r.previous, r.unit_price) for r in alerts] == [(1, 100.0, 130.0)]
    events = [[(1, s(0), "failure"), (1, s(1), "failure")], [(1, s(2), "failure"), (1, s(3), "success")], [(1, s(4), "failure"), (1, s(5), "failure")]]
    blocked = run(spark, tmp_path, events, "key long, ts timestamp, kind string", lambda x: streams.throttle(x, 3, 900), "append", "blocked")
    assert [(r.key, r.ts) for r in blocked] == [(1, s(2))]
    signals = run(spark, tmp_path, [[("m", i) for i in range(4)], [("m", i) for i in range(4, 11)]], "model string, id int", streams.retrain_trigger, "append", "signals")
    assert sorted(r.labels for r in signals) == [5, 10]


def test_intake_and_sessions_stream(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    days = run(spark, tmp_path, [[(h(1), "view"), (h(2), "view")], [(h(30), "view")], [(h(120), "view")], [(h(121), "view")], [(h(0), "view")]], "ts timestamp, event_type string", streams.intake_counts, "append", "intake")
    assert [(r.start, r.n) for r in sorted(days)] == [(T0, 2), (h(24), 1)]
    runs = run(spark, tmp_path, [[(1, h(0), h(1)), (1, h(0.5), h(2))], [(1, h(40), h(41))]], "bid_id long, started_at timestamp, finished_at timestamp", streams.turnaround, "append", "sessions")
    assert [(r.bid_id, r.seconds) for r in runs] == [(1, 7200)]


def test_feed_join(spark):
    feed = spark.createDataFrame([("m", "USD", 10.0), ("z", "USD", 1.0)], "mpn string, currency string, unit_price double")
    got = streams.feed_join(feed, spark.createDataFrame([("m", "Mouse")], "mpn string, name string"), spark.createDataFrame([("USD", 0.0125)], "currency string, rate double"))
    assert [(r.name, r.price_base) for r in got.collect()] == [("Mouse", 800.0)]
