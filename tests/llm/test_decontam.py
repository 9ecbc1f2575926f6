from __future__ import annotations

import random
import re
from collections import defaultdict

from bidframe.llm.decontam import NAME, NUMBER, UNIT, UNITS, drop_leaks, leaks

from .helpers import documents


def brute_tokens(text):
    text = text or ""
    out = []
    spans = re.finditer(r"(?<![^\W_])([0-9]+)(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?(?![^\W_])|[^\W_]+", text)
    for m in spans:
        t = m.group()
        if m.group(1):
            out.append(NUMBER + "_".join(g or "" for g in m.groups()))
        elif out and out[-1][0] == NUMBER and t.lower() in UNITS and t == t.lower() and text[m.start() - 1] in " -":
            out.append(UNIT + t)
        elif re.fullmatch(r"[A-Z][a-zé]+", t) and m.start() > 1 and text[m.start() - 1] == " " and (text[m.start() - 2].isalnum() or text[m.start() - 2] in ",;:"):
            out.append(NAME + t.lower())
        else:
            out.append(t.lower())
    return out


def brute(docs, items, size=5, least=0.5):
    def windows(tokens):
        return {i: tokens[i : i + size] for i in range(len(tokens) - size + 1)}

    def kind(x):
        return x[0] if x[0] in (NUMBER, UNIT, NAME) else x

    found = {}
    for d, text in docs:
        dw = windows(brute_tokens(text))
        for item, t in items:
            iw = windows(brute_tokens(t))
            runs = defaultdict(list)
            for p, a in dw.items():
                for q, b in iw.items():
                    if [kind(x) for x in a] == [kind(x) for x in b]:
                        runs[p - q].append((p, q))
            places, changed = set(), False
            for run in runs.values():
                pairs = {(x, y) for p, q in run for x, y in zip(iw[q], dw[p]) if x[0] in (NUMBER, UNIT, NAME)}
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    places |= {q for _, q in run}
                    changed |= any(x != y for x, y in pairs)
            if iw and len(places) / len(iw) >= least:
                found[d, item] = (len(places), len(iw), changed)
    return found


ITEMS = [
    (1, "A train leaves the town with Alice at 30 km per hour and drives 2.5 hours, then Alice rests 30 minutes."),
    (2, "plain words only make up this second question about nothing at all"),
    (3, "too short item"),
    (4, "plain words only make up this second question about nothing at all"),
    (5, None),
]
DOCS = [
    (10, "Intro here. A train leaves the town with Alice at 30 km per hour and drives 2.5 hours, then Alice rests 30 minutes. More text."),
    (11, "x y z A train leaves the town with Bob at 45 km per hour and drives 3.5 hours, then Bob rests 45 minutes."),
    (12, "A train leaves the town with Bob at 45 km per hour and drives 3.5 hours, then Carol rests 50 minutes."),
    (13, "so plain words only make up this second question about nothing at all, plain words only make up this"),
    (14, "plain words only make a different sentence about nothing at all that matters here"),
    (15, None), (16, ""), (17, "plain WORDS only make up this second question about"), (None, "plain words only make up this second question about nothing at all"),
]


def test_matches_brute_force(spark):
    rng = random.Random(2)
    docs = list(DOCS)
    for d in range(100, 140):
        words = rng.choice(ITEMS[:2])[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["Zed", "7", "km", "other", "Alice"])
        docs.append((d, " ".join(rng.choice(["lead words", "Then 5 km"]) for _ in range(3)) + " " + " ".join(words)))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = leaks(documents(spark, docs + [(10, DOCS[0][1])]), bench).collect()
    assert {(r.doc_id, r.item_id): (r.matched, r.windows, r.reparameterised) for r in got} == brute(docs, ITEMS)
    assert len({(r.doc_id, r.item_id, r.text_key) for r in got}) == len(got)
    ids = {(r.doc_id, r.item_id): r.reparameterised for r in got}
    assert ids[10, 1] is False and ids[11, 1] is True and (12, 1) not in ids


def test_filter_and_edges(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, DOCS + [(None, "free text")]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "window")
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect() if r.text is not None) == sorted((d or 0, t) for d, t in [*DOCS[2:3], DOCS[4], DOCS[6], (None, "free text")])
    assert leaks(documents(spark, []), bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0


def test_values_that_become_equal(spark):
    items = [(1, "The farm sells boxes with 3 apples and 5 pears for every guest of the party"), (2, "we measure the road in 7 km and then again in 9 miles before we go home")]
    docs = [(1, "The farm sells boxes with 4 apples and 4 pears for every guest of the party"), (2, "we measure the road in 7 km and then again in 9 km before we go home")]
    found = leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched == r.windows, r.reparameterised) for r in found} == {(1, 1, True, True), (2, 2, True, True)}


def test_renamed_questions_whose_names_start_sentences(spark):
    rng = random.Random(8)
    item = "Mary has 12 apples. Mary gives 5 apples to John. John eats two of them. How many apples does Mary have now?"
    names = ["Peter", "Lisa", "Omar", "Ines", "Zoë", "Ravi", "Chen", "Ada"]
    docs = []
    for k in range(100):
        a, b = rng.sample(names, 2)
        docs.append((k, f"{rng.choice(['Intro text. ', 'A note: ', ''])}{a} has {rng.randint(20, 99)} apples. {a} gives {rng.randint(2, 9)} apples to {b}. {b} eats two of them. How many apples does {a} have now? End."))
    docs += [(200, "Peter has 9 apples."), (201, "Mary has many friends. Mary gives a talk to John. John sleeps through all of it. How many slides does Mary have now?"), (202, "An old orchard. The trees give fruit. Children eat them. How nice.")]
    found = leaks(documents(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(100)) and all(r.reparameterised for r in found)


def test_names_inside_sentences_still_bear_witness(spark):
    item = "On Monday Alice meets Bob at the gate and then Alice leaves Bob behind at the gate again"
    docs = [(1, item.replace("Alice", "Carol")), (2, "On Monday Carol meets Bob at the gate and then Dora leaves Bob behind at the gate again")]
    found = leaks(documents(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1}
