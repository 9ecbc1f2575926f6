from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidframe.llm import mixing
from bidframe.llm.mixing import exponent, mix_sources, mixed

from .helpers import SCHEMA


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def shares(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(t / total,) for t in tokens], "p double")


def test_exponent_meets_the_repetition_limit(spark):
    tokens = [1000, 300, 50, 5]
    t = exponent(shares(spark, tokens), 1.0, 3.0, None)

    def repeats(t):
        p = [x / sum(tokens) for x in tokens]
        z = sum(x**t for x in p)
        return max(x ** (t - 1) / z for x in p)

    assert repeats(t) <= 3.0 < repeats(t - 1e-6)


def test_exponent_meets_the_entropy(spark):
    tokens = [1000, 300, 50, 5]
    t = exponent(shares(spark, tokens), 1.0, None, 0.9)
    p = [x / sum(tokens) for x in tokens]

    def entropy(t):
        w = [x**t for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    goal = 0.9 * math.log(4)
    # the smallest exponent at which the entropy is no longer above the target
    assert entropy(t - 1e-6) >= goal > entropy(t) - 1e-9
    assert exponent(shares(spark, [5, 5]), 1.0, None, 1.0) == 1.0
    assert exponent(shares(spark, [5, 5]), 1.0, 1.0, None) == 0.0


@pytest.mark.parametrize("block", [3, 10_000])
def test_budgets_hold(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", None), (None, "a b", "null ids"), (None, "a b", "null ids"), (5, "w w", None)]
    table = docs(spark, rows)
    got = mixed(table, budget_share=1.0, max_repeats=2.0).collect()
    assert len(got) == len(rows)
    used, own, weight = defaultdict(int), defaultdict(int), {}
    for r in got:
        used[r.source] += r.copies * r.n_tokens
        own[r.source] += r.n_tokens
        weight[r.source] = r.weight
        assert r.copies == 0 if r.n_tokens == 0 else r.copies >= 0
    total = sum(own.values())
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in own:
        assert weight[s] * total - 7 <= used[s] <= weight[s] * total + 1e-6
        assert used[s] <= 2 * own[s] + 1e-6
    taken = Counter(r.doc_id for r in mix_sources(table, budget_share=1.0, max_repeats=2.0).collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert taken == +want


def test_stage_keeps_columns_and_takes_no_document_twice(spark):
    table = docs(spark, [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(90)]).withColumn("copies", F.lit("x")).withColumn("block", F.lit(1))
    kept = mix_sources(table, budget_share=0.8, max_repeats=1.0)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 50 < len(ids) < 90


def test_empty(spark):
    assert mixed(docs(spark, [])).count() == 0
    assert [r.copies for r in mixed(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]
