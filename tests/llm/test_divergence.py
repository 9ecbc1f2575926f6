"""Source divergence against a brute-force version."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from bidframe.llm import divergence
from bidframe.llm.divergence import audit_sources, terms
from tests.llm.helpers import SCHEMA

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, total, groups = Counter(), Counter(), {}
        for own, source, words in rows:
            if own == lang:
                docs.update(set(words))
                total.update(words)
                groups.setdefault(source, Counter()).update(words)
        kept = [w for w in docs if docs[w] >= min_docs]
        v = len(kept)

        def share(counts, word):
            return 1 + 1_000_000_000 * (counts[word] + 5) // (sum(counts[w] for w in kept) + 5 * v)

        shares = {s: {w: share(c, w) for w in kept} for s, c in groups.items()}
        for s, own in shares.items():
            pairs = sorted(((sum(abs(own[w] - other[w]) for w in kept), item) for item, other in shares.items() if item != s), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", item, f, k + 1) for k, (f, item) in enumerate(pairs)}
            words = sorted(((own[w] - share(total, w), w) for w in kept if groups[s][w] and own[w] > share(total, w)), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "term", w, f, k + 1) for k, (f, w) in enumerate(words[:top])}
    return out


def made(seed, n=300):
    draw = random.Random(seed)
    words = ["the", "THE", "über", "ÜBER", "naïve", "a", "b1c", "日本", "x_y", *(f"w{chr(97 + k)}{chr(97 + k // 2)}" for k in range(20))]
    rows = []
    for k in range(n):
        text = " ".join(draw.choices(words, k=draw.randint(0, 30)))
        rows.append((k, draw.choice([text, text, text, None, ""]), draw.choice(["en", "en", "de", None]), draw.choice(["s0", "s0", "s1", "é", None, "z" * 50]), 0))
    rows += [(1000, "1 2 3", "quiet", "only", 0), (1001, "", "two", "p", 0), (1002, "lone", "two", "q", 0)] + [(7, "the same row the", "en", "s0", 0)] * 5
    return rows


@pytest.mark.parametrize(("bits", "tile", "block"), [(64, 128, 16_384), (3, 2, 16)])
def test_equals_brute_force(spark, monkeypatch, bits, tile, block):
    """Also with colliding digests, several tiles of sources and blocks of terms."""
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    rows = made(bits)
    found = audit_sources(spark.createDataFrame(rows, SCHEMA), min_docs=30, top=6, digest_bits=bits)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 30, 6)


def test_no_rows_and_clashing_columns(spark):
    assert audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame(made(1, 100), SCHEMA)
    clash = rows.selectExpr("*", "1 AS term", "2 AS digest", "3 AS n", "4 AS docs", "5 AS own", "6 AS value", "7 AS p", "8 AS kept")
    assert sorted(audit_sources(clash, 10, 5).collect()) == sorted(audit_sources(rows, 10, 5).collect())


def test_ties_go_by_utf8_bytes(spark):
    rows = [(k, f"{w} common", "en", s, 0) for k, (w, s) in enumerate([(w, s) for w, s in (("é", "a"), ("z", "a"), ("\U0001f600", "a"), ("ａ", "a"), ("other", "b")) for _ in range(4)])]
    found = audit_sources(spark.createDataFrame(rows, SCHEMA), min_docs=4, top=3).where("part = 'term' AND source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in found] == ["z", "é", "ａ"]


def test_long_text_and_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = [(1, "ab " * 200_000 + "q" * 100_000, "en", "s", 0), *((k, "ab cd", "en", "t", 0) for k in range(2, 6))]
    got = {tuple(r) for r in audit_sources(spark.createDataFrame(rows, SCHEMA), min_docs=2).collect()}
    assert got == brute(rows, 2, 50)


def test_terms_are_runs_of_letters():
    assert terms("A1b_Ça- x\x7fy".encode()) == [b"a", b"b", "Ça".encode(), " x".encode(), b"y"]
