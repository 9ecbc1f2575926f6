from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from bidframe.llm.pii import KINDS, find_personal_data, joined, spans

from .helpers import documents


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def test_base_matches_brute_force(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "x-y", " ", "+", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.1.1", "é", "\n", "(0)", "1", "0", "-", "+49 151 234567", "007.1.2.3", "u@h.de", "e" * 30]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (None, "q@r.st"), (9001, None), (9003, "a" * 300_000 + "@"), (9004, "1" * 300_000), (9005, "word " * 50_000 + "x@y.zz")]
    got = find_personal_data(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        if len(text) >= 300_000:
            assert r.spans == ""
            continue
        want = brute(text)
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("é write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("mail anna at mail dot example dot org ok", "email", "anna at mail dot example dot org"),
    ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ("ip one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("card 4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
])
def test_disguises_map_back_to_the_source(text, kind, hidden):
    base, every = spans(text)
    assert base == []
    assert [(KINDS[k], text[a:b]) for a, k, b in every] == [(kind, hidden)]


@pytest.mark.parametrize("text", ["", "one two three", "the cat sat at the door", "Licensed under the Apache License, Version 2.0.", "dot at dot at"])
def test_clean_texts_stay_clean(text):
    assert spans(text) == ([], [])


def test_empty_table_and_extra_columns(spark):
    docs = documents(spark, []).withColumnRenamed("lang", "spans")
    assert find_personal_data(docs).count() == 0


@pytest.mark.parametrize("gap", [" ", "-", ",", ".", " - ", " dot ", "dot ", " point", "(", "@", " at ", "+", "1 ", "5. ", "one ", "plus ", "\u2024", "[at]", "a@"])
@pytest.mark.parametrize("head", ["one two 5", "plus one two three 5", "+5", "mail me at a"])
def test_long_gaps_take_linear_time(head, gap):
    """Every expression meets long runs of what may follow it; a nested quantifier would not end."""
    took = []
    for n in (10_000, 80_000):
        text = head + gap * n + "x"
        began = time.perf_counter()
        spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_spelled_digits_over_long_gaps():
    text = "call plus four  -  nine, one" + " " * 500 + "two three four five six seven eight nine now"
    assert [(k, a) for a, k, _ in spans(text)[1]] == [(3, 5)]
