"""Importance resampling against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidframe.llm import resampling
from bidframe.llm.resampling import Dictionary, compose, resample, shift_table
from tests.llm.helpers import documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = 10_000


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % BUCKETS for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target, percent=5, least=20):
    s, t, own = Counter(), Counter(), []
    for doc, text in rows:
        n, found = grams(text)
        s.update(found)
        own.append((doc, n, found))
    for text in target:
        t.update(grams(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for doc, n, found in own:
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[:percent * len(able) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((r[0], r[2], r[3], r[4], rank[r].pop(0) if rank.get(r) else None) for r in out), key=str)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def made(seed, n=250):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "d4", "naïve", "日本語", "it's", "x" * 90, *(f"w{k}" for k in range(60))]
    rows = [(k, draw.choice(["", " ", "\n", "\x00 "]).join([draw.choice(words) + draw.choice([" ", ", ", ".\n"]) for _ in range(draw.randint(0, 60))])) for k in range(n)]
    return rows + [(None, "alone " * 30), (500, None), (501, ""), (502, "two words"), (7, "w1 w2 w3 " * 10), (7, "w1 w2 w3 " * 10)]


@pytest.mark.parametrize("piece", [8 << 20, 200])
def test_equals_brute_force(spark, monkeypatch, piece):
    """Also where a document is cut into pieces and an automaton serves few texts."""
    monkeypatch.setattr(resampling, "PIECE", piece)
    rows, target = made(piece), ["Alpha beta w1 w2 w3", "w1 w2", None, ""]
    found = resample(documents(spark, rows), items(spark, target)).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, target)


def test_ties_go_to_the_smaller_id_and_null_ids_come_last(spark):
    same = "w1 w2 w3 w4 w5 " * 5
    rows = [(k, same) for k in range(40)] + [(None, same)] * 40
    got = resample(documents(spark, rows), items(spark, ["w1"]), share_percent=50)
    drawn = [(r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert len(drawn) == 40 and drawn == sorted(drawn, key=lambda x: (-x[0], x[1] < 0, x[1]))
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 41))


def test_empty_tables_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert resample(empty, items(spark, ["a"])).count() == 0
    rows = documents(spark, made(3, 60))
    clash = rows.selectExpr("*", "1 AS n_words", "2 AS features", "3 AS row", "4 AS part", "5 AS place", "6 AS weight", "7 AS rank", "8 AS item_id")
    target = items(spark, []).withColumn("features", F.lit(1))
    assert sorted(map(str, resample(clash, target).collect())) == sorted(map(str, resample(rows, target).collect()))


def test_very_long_text(spark):
    rows = [(1, "word other " * 120_000 + "z" * 300_000), (2, "word")]
    got = resample(documents(spark, rows), items(spark, ["word"])).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ["word"])


def test_composed_checksums():
    for size in (0, 1, 7, 64, 1000, 123_456):
        table, crc = shift_table(size), zlib.crc32(b"first")
        moved = 0
        for b in range(4):
            moved ^= int(table[b, crc >> 8 * b & 255])
        assert moved ^ zlib.crc32(b"x" * size) == zlib.crc32(b"first" + b"x" * size)
    words = Dictionary({b"aa", b"b", "é".encode()})
    runs = compose(words, words.scan(" b aa é b ".encode()), 3)
    assert [int(x) for x in runs[2]] == [zlib.crc32("b aa é".encode()), zlib.crc32("aa é b".encode())]
    assert len(words.scan(b" ")) == 0
