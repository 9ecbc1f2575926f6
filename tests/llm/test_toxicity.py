from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from bidframe.llm.toxicity import (
    DROP_PRICE, LETTERS, READINGS, REPEAT_PRICE, SEPARATORS, SIGN_PRICE, SIGNS, Reader, decode, drop_toxic, language_model, letter_model, readings, readings_cost, restored, scanned, score_documents)

from .helpers import documents

CLEAN = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "sto", "ri") for c in ("", "n", "lu")]
BAD = ["idiot", "moron", "stupid", "trash"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    return language_model(documents(spark, corpus(300)[0]))


def test_language_model_is_a_distribution(model):
    assert model.shape == (LETTERS,) * 3
    assert np.allclose(np.exp(model).sum(axis=2), 1)


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("tr@$h", "trash"), ("idiot", "idiot")])
def test_decoding(model, token, word):
    assert decode(token, model.tolist()) == word
    assert word in Reader(model).words(f"lona {token} basto")


@pytest.mark.parametrize(("text", "word"), [
    ("b a n a i d i o t", "idiot"), ("l o n a " * 15 + "i d i o t", "idiot"), ("s t u p i d m o r o n", "moron"),
    ("i" + "." * 20 + "d" + "." * 20 + "i.o.t", "idiot"), ("stu" + "u" * 70 + "pid", "stupid"), ("m" + "-" * 300 + "0r0n", "moron"),
])
def test_disguises_of_any_length(model, text, word):
    assert word in Reader(model).words(f"terri {text} basto")


def test_held_out_accuracy_and_disguises(spark):
    rows, labels = corpus(600)
    extra = [(1000, "bana 1d10t lori m0r0n"), (1001, "bana s t u p i d loston"), (1002, None), (1003, ""), (1004, "bana lori"), (None, "idiot moron stupid"), (1000, "bana 1d10t lori m0r0n"), (1005, "bana lori " * 30_000)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score_documents(documents(spark, rows + extra), table).collect()
    assert len(got) == len(rows) + len(extra)
    want = {d: t for d, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    predicted = {r.doc_id: r.predicted for r in got}
    assert predicted[1000] == predicted[1001] == predicted[None] == 1
    assert predicted[1002] == predicted[1003] == predicted[1004] == predicted[1005] == 0


def test_filter_keeps_columns(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows).withColumnRenamed("source", "score")
    kept = drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    want = {d for d, _, t in labels if not t}
    assert len({r.doc_id for r in kept.collect()} ^ want) <= 0.05 * len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_documents(documents(spark, []), none).count() == 0
    got = score_documents(documents(spark, [(1, "a b")]), none).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 0.5)]


def all_readings(token, model):
    """Every way to read a token with its price and cost, by brute force."""
    found = {}

    def walk(i, text, price):
        if i == len(token):
            cost = readings_cost(text, model)
            if text not in found or price + cost < sum(found[text]):
                found[text] = (price, cost)
            return
        c = token[i]
        if c in SIGNS:
            for x in SIGNS[c]:
                walk(i + 1, text + x, price + SIGN_PRICE)
            if i + 1 == len(token) and c in "!|+(":
                walk(i + 1, text, price)
        elif c in SEPARATORS:
            walk(i + 1, text, price + DROP_PRICE)
        elif c.isalpha():
            walk(i + 1, text + c, price)
        else:
            walk(i + 1, text, price + 2 * DROP_PRICE)
        if i and token[i - 1] == c and c not in SEPARATORS and (c in SIGNS or c.isalpha()):
            walk(i + 1, text, price + REPEAT_PRICE)

    walk(0, "", 0.0)
    return sorted((sum(v), k) for k, v in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_decoding_matches_all_readings(model, seed):
    rng, table = random.Random(seed), model.tolist()
    for _ in range(60):
        token = "".join(rng.choice("iiddott0156!|.-@é") for _ in range(rng.randint(1, 9)))
        want = all_readings(token, table)
        got = readings(token, table)
        assert len(got) == min(READINGS, len(want))
        assert np.allclose([p + c for p, c, _ in got], [x for x, _ in want[: len(got)]])
        assert abs(readings_cost(decode(token, table), table) + got[0][0] - want[0][0]) < 1e-9


def test_word_table_decides_between_readings(spark):
    rows = [(d, "the sill is by the dill and the till") for d in range(50)] + [(100, "a d1ll and a s1ll"), (101, "a xzg6q"), (102, "")]
    scan = scanned(documents(spark, rows))
    found = {(r.token, r.word) for r in restored(scan, letter_model(scan)).collect()}
    assert {("d1ll", "dill"), ("s1ll", "sill")} <= found
    more = scanned(documents(spark, rows + [(d, f"word{d % 7}x new{'a' * (d % 5)}b") for d in range(200, 240)]))
    assert more.count() > scan.count()  # the table grows with the corpus


def test_clashing_columns_and_repeats(spark):
    rows, labels = corpus(300)
    table = spark.createDataFrame([(d, q, t, "x") for d, q, t in labels], "doc_id long, quality int, toxic int, text string")
    docs = documents(spark, rows + [rows[0], (None, None), (None, "idiot moron stupid")]).withColumnRenamed("lang", "row").withColumnRenamed("source", "toxic").withColumnRenamed("n_chars", "words")
    got = score_documents(docs, table).collect()
    assert len(got) == len(rows) + 3
    kept = drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
