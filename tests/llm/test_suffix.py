from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from bidframe.llm import suffix
from bidframe.llm.suffix import blind_trie, remove_repeats, repeated_ranges, sorted_suffixes

from .helpers import documents


def shared_runs(data, ids, passage, words):
    """Runs of over ``words`` words covered by strings of ``passage`` bytes that another document has."""
    owners = defaultdict(set)
    for i, b in zip(ids, data):
        for p in range(len(b) - passage + 1):
            owners[b[p : p + passage]].add(i)
    counts = []
    for b in data:
        held = bytearray(len(b))
        for p in range(len(b) - passage + 1):
            if len(owners[b[p : p + passage]]) > 1:
                held[p : p + passage] = b"\x01" * passage
        masked, n, at = bytes(held), 0, 0
        while (a := masked.find(b"\x01", at)) >= 0:
            at = masked.find(b"\x00", a)
            at = len(b) if at < 0 else at
            n += len(b[a:at].split()) > words
        counts.append(n)
    return counts


def brute(rows, length, passage, words):
    seen = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    shared = shared_runs(data, [str(r) for r in rows], passage, words)
    for k, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((k, p))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = b"\x01" * length
    out = []
    for (d, _), b, g, s in zip(rows, data, gone, shared):
        kept = bytes(x for x, y in zip(b, g) if not y)
        runs = sum(y and not (i and g[i - 1]) for i, y in enumerate(g))
        out.append((d, len(b), sum(g), runs, hashlib.sha256(kept).hexdigest(), s))
    return sorted(map(str, out))


def table(rng, n, alphabet, passages):
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : rng.randint(a, len(p))])
        rows.append((d, "".join(parts)))
    return rows


def test_blind_trie_sorts_and_groups():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(400)]
    groups = blind_trie(strings)
    assert sorted(i for g in groups for i in g) == list(range(400))
    keys = [strings[g[0]] for g in groups]
    assert keys == sorted(set(strings)) and all(strings[i] == k for g, k in zip(groups, keys) for i in g)


def test_sorted_suffixes():
    rng = random.Random(2)
    for size in (1, 2, 50, 300):
        strings = [bytes(rng.choice(b"ab") for _ in range(40)) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(size)]
        key = np.sort(np.array([rng.randint(0, 3) for _ in strings]))
        order, common = sorted_suffixes(key, strings)
        pairs = [(int(key[k]), strings[k].ljust(48, b"\0")) for k in order]
        assert pairs == sorted(pairs) and sorted(order.tolist()) == list(range(size))
        for (k, x), (j, y), c in zip(pairs, pairs[1:], common[1:].tolist()):
            assert c == (next((i for i in range(48) if x[i] != y[i]), 48) if k == j else -1)


def test_repeated_ranges():
    parts = [(b"xxabcdefghijYY", 0, 2, 1, 1), (b"zzabcdefghijYQ", 0, 2, 1, 2), (b"qqqbcdefghijYY", 0, 2, 3, 3)]
    one = np.zeros(3, np.int64)
    assert sorted(repeated_ranges(one, parts, 11, 11)) == [(0, 0, 0, 1), (0, 0, 0, 2), (1, 0, 0, 1), (1, 0, 0, 2)]
    assert sorted(repeated_ranges(one, parts, 13, 11)) == [(0, 0, 0, 2), (1, 0, 0, 2)]
    same = [(r, low, high, 1, 1) for r, low, high, _, _ in parts]
    assert sorted(repeated_ranges(one, same, 11, 11)) == [(0, 0, 0, 1), (1, 0, 0, 1)]
    assert repeated_ranges(np.array([0, 1, 2]), parts, 11, 11) == []


@pytest.mark.parametrize(("gram", "group", "piece", "passage"), [(8, 512, 1 << 20, 40), (8, 2, 1 << 20, 40), (16, 3, 60, 40), (40, 512, 97, 40), (8, 512, 1 << 20, 25), (8, 2, 1 << 20, 25), (8, 1, 70, 20), (20, 2, 97, 20)])
def test_matches_brute_force(spark, monkeypatch, gram, group, piece, passage):
    monkeypatch.setattr(suffix, "GRAM", gram)
    monkeypatch.setattr(suffix, "GROUP_MAX", group)
    monkeypatch.setattr(suffix, "PIECE", piece)
    rng = random.Random(gram * 100 + group)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(60, 200))) for _ in range(5)]
    rows = table(rng, 60, "abcdeé", passages)
    rows += [(900, None), (901, ""), (902, "ab" * 100), (903, "x" * 300), (904, rows[3][1]), (904, rows[3][1]), (None, passages[0] + "tail"), (None, "q" + passages[1]), (905, passages[2] * 3)]
    got = remove_repeats(documents(spark, rows), 40, passage, 5).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 40, passage, 5)


def test_full_length(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = [(d, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 1500))) + passage[rng.randint(0, 400) : rng.randint(700, 1000)] + str(d)) for d in range(25)]
    got = remove_repeats(documents(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "cls")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 400, 256, 50)


def test_empty(spark):
    assert remove_repeats(documents(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in remove_repeats(documents(spark, [(1, "short")])).collect()] == [(1, 5, 0, 0)]


def test_ranges_of_a_class_become_runs(spark):
    """Single offsets of the deeper levels do not meet the members one by one."""
    rows = [(1, k, k, suffix.SHARED) for k in range(60)] + [(1, 3, 9, suffix.LONG), (1, 8, 12, suffix.LONG | suffix.SHARED), (1, 70, 71, suffix.SHARED), (2, 4, 4, suffix.LONG)]
    got = suffix._runs(spark.createDataFrame(rows, suffix.RANGES)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 59, suffix.SHARED), (1, 3, 12, suffix.LONG), (1, 70, 71, suffix.SHARED), (2, 4, 4, suffix.LONG)]
