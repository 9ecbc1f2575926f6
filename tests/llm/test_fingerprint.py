from __future__ import annotations

import hashlib
import random

import pytest

from bidframe.llm import fingerprint as module
from bidframe.llm.fingerprint import edit_distance, fingerprint, fingerprint_documents, likeness, rolling

from .helpers import documents


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert edit_distance(a, b) == brute_distance(a, b)


def test_rolling_hash_matches_brute_force(monkeypatch):
    monkeypatch.setattr(module, "_PIECE", 50)
    data = random.Random(2).randbytes(180)
    for i, got in enumerate(rolling(data).tolist()):
        w = (bytes(6) + data)[i : i + 7]
        shifted = 0
        for j in range(7):
            shifted ^= (w[6 - j] << (5 * j % 32)) & 0xFFFFFFFF
        assert got == (sum(w) + sum((j + 1) * x for j, x in enumerate(w)) + shifted) % (1 << 32)


def test_likeness_follows_edits():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefghij ") for _ in range(5000))
    other = bytes(rng.choice(b"abcdefghij ") for _ in range(5000))
    changed = text[:2500] + b"inserted words" + text[2500:]
    assert likeness(fingerprint(text), fingerprint(text)) == 1.0
    assert likeness(fingerprint(text), fingerprint(changed)) > 0.8
    assert likeness(fingerprint(text), fingerprint(text[:3000])) > 0.4
    assert likeness(fingerprint(text), fingerprint(other)) < 0.2
    assert fingerprint(b"") == "3::"


@pytest.mark.parametrize("cell", [7, 5000])
def test_neighbours_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(module, "CELL", cell)
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice("abcé d") for _ in range(rng.randint(0, 300)))) for i in range(100)]
    rows += [(None, "first of all"), (31, None), (31, None), (32, ""), (33, "same"), (33, "same"), (33, "other"), (400, "y" * 100_000)]
    shuffled = rng.sample(rows, len(rows))
    got = fingerprint_documents(documents(spark, shuffled)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        f, e, n = (fingerprint(x.encode()) for x in (t, edited, after))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, n)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_small_tables(spark):
    assert fingerprint_documents(documents(spark, [])).count() == 0
    (only,) = fingerprint_documents(documents(spark, [(4, "abcdefgh")])).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only.near_next == 1.0
