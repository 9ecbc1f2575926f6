from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from bidframe.llm import sharding
from bidframe.llm.sharding import difference, shard_documents

from .helpers import documents


def brute_difference(sizes, k):
    """Karmarkar-Karp over full k-tuples, without tricks."""
    tuples = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[0] - t[-1])
        a, b = tuples.pop(), tuples.pop()
        tuples.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return tuples[0]


@pytest.mark.parametrize("k", [2, 3, 7])
def test_differencing_matches_brute_force(k):
    rng = random.Random(k)
    sizes = rng.sample(range(1, 100_000), 60)
    places = difference([[(s, i)] for i, s in enumerate(sizes)], k)
    assert sorted(x for p in places for x in p) == list(range(60))
    assert sorted((sum(sizes[i] for i in p) for p in places), reverse=True) == brute_difference(sizes, k)


def check(rows, got, shards):
    assert len(got) == len(rows)
    by_text, slots, sums = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t or "")
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        match = [t for t in texts[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32 and len(t.encode()) + 16 == r["size"]]
        assert match
        by_text[match[0]].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_shards_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 50)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    monkeypatch.setattr(sharding, "BLOCK", 10)
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(1, 400) + str(i % 700)) for i in range(800)]
    sums = check(rows, shard_documents(documents(spark, rows), 8).collect(), 8)
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 8


def test_edge_cases(spark):
    assert shard_documents(documents(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (None, None)] + [(k, "copy" * 50) for k in range(10, 40)]
    docs = documents(spark, rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "size")
    got = shard_documents(docs, 5).collect()
    check([(d, t) for d, t in rows], got, 5)
    assert len({r.shard for r in got if r["size"] == 16}) == 1
