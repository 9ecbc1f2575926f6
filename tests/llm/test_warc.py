"""Archives, the two-level index, and lookups against scans."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random

import pytest

from bidframe.llm import warc
from bidframe.llm.warc import archive_pages, lookup, parse_record, read_records, record, replay, resolved, url_key

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def brute(rows, min_bytes=0):
    keeper = {}
    for page, _, html in rows:
        key = (html or "").encode()
        keeper[key] = page if keeper.get(key) is None else max(keeper[key], page if page is not None else keeper[key])
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = keeper[data]
        again = len(data) >= min_bytes and first is not None and page != first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def made(seed, n=120):
    draw = random.Random(seed)
    bodies = ["", None, "<p>ü €\U0001f600</p>", "a\r\n\r\nWARC/1.1\r\n", *(f"<html>{k}</html>" for k in range(30))]
    hosts = ["Www.Example.com", "example.com:80", "a.example.com", "10.0.0.1:8080", "[::1]", "user@b.org"]
    urls = [None, "", "not a url", "http://[bad", "HTTP://x/\r\ny", *(f"http://{draw.choice(hosts)}/{draw.choice('abc')}?q={k % 3}#f" for k in range(20))]
    rows = [(k, draw.choice(urls), draw.choice(bodies)) for k in range(n)]
    return rows + [(None, None, "<html>1</html>"), (None, "http://n.org/", "nulls only"), (None, "http://n.org/", "nulls only"), (5, "http://dup.org/", "dup"), (5, "http://dup.org/", "dup"), (4, "http://dup.org/", "dup")]


@pytest.mark.parametrize(("lines", "archive", "limit", "min_bytes"), [(1_000, 256 << 20, 500_000, 0), (2, 400, 0, 5)])
def test_replay_equals_brute_force(spark, monkeypatch, lines, archive, limit, min_bytes):
    """Also with tiny blocks and archives, and where the repeated payloads are not broadcast."""
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    rows = made(lines)
    found = replay(pages(spark, rows), min_bytes)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, min_bytes)


def test_lookup_finds_what_a_scan_finds(spark):
    rows = made(9, 400)
    index = archive_pages(pages(spark, rows), block_lines=3)
    asked = ["http://example.com/a?q=0", "https://EXAMPLE.com/a?q=0#other", "http://a.example.com/b?q=1", None, "http://nowhere.org/", "http://dup.org/"]
    got = lookup(index, spark.createDataFrame([(u,) for u in asked * 3], "url string")).collect()
    keys = {url_key(u) for u in asked}
    assert sorted((r["urlkey"], str(r["page_id"])) for r in got) == sorted((url_key(u), str(p)) for p, u, _ in rows if url_key(u) in keys)


def test_revisits_resolve_to_payloads(spark):
    rows = made(4)
    index = archive_pages(pages(spark, rows), block_lines=4)
    asked = pages(spark, rows).select("url", "page_id")
    records = read_records(index, lookup(index, asked, by_page=True), with_payload=True)
    got = sorted(((r["page_id"], r["payload"]) for r in resolved(index, records).collect()), key=str)
    assert got == sorted(((p, h or "") for p, _, h in rows), key=str)


def test_archives_are_valid_gzip_members(spark, tmp_path):
    rows = made(2, 20)
    index = archive_pages(pages(spark, rows), folder=f"file://{tmp_path}")
    data = b"".join(gzip.open(tmp_path / f).read() for f in os.listdir(tmp_path) if f.endswith(".warc.gz"))
    assert data.count(b"WARC-Type: ") == len(rows) and index.ranges.count() >= 1
    blocks = b"".join(gzip.open(tmp_path / f).read() + b"\n" for f in os.listdir(tmp_path) if f.endswith(".cdx.gz"))
    assert len(blocks.splitlines()) == len(rows)


def test_no_pages_and_clashing_columns(spark):
    assert replay(pages(spark, [])).count() == 0
    rows = made(6, 30)
    clash = pages(spark, rows).selectExpr("*", "1 AS digest", "2 AS payload", "3 AS keeper", "4 AS file", "5 AS urlkey", "6 AS n")
    assert sorted((tuple(r) for r in replay(clash).collect()), key=str) == brute(rows)


def test_long_payload(spark):
    rows = [(1, "http://long.org/", "x" * 3_000_000), (2, "http://long.org/", "y" * 2_000_000 + "é"), (3, "http://long.org/2", "x" * 3_000_000)]
    assert sorted((tuple(r) for r in replay(pages(spark, rows)).collect()), key=str) == brute(rows)


def test_keys():
    assert url_key("https://User@WWW.Example.co.uk:443/a/b?x=1&y#z") == "uk,co,example,www)/a/b?x=1&y"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key(None) == "" and url_key("http://10.0.0.1/x") == "10.0.0.1)/x"


def test_damage_is_an_error():
    data = record(3, "http://a/", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, None, False, "2020-01-01T00:00:00Z")
    assert parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        parse_record(data.replace(b"payload\r\n", b"pAyload\r\n"))
