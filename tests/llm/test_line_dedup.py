from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from bidframe.llm.line_dedup import LineRuns, dedup_lines

from .helpers import documents

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least=20, docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(low)
    held = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        for x in {key(line) for line in (t or "").split("\n")}:
            if len(x) >= least:
                held[x].append(k)
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    keeper = {x: max(order(k) for k in ks) for x, ks in held.items() if len(ks) >= docs}
    out = []
    for k, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), order(k)) == order(k)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_matches_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    lines = [f"This is the repeated line number {k} é" for k in range(12)] + ["short", "", "  padded line of twenty chars \t", "PADDED line of twenty CHARS", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for d in range(60)]
    rows += [(100, None), (101, ""), (None, lines[0] + "\n" + lines[1]), (None, lines[0]), (59, lines[2]), (59, lines[2]), (102, (lines[3] + "\n") * 5000)]
    got = dedup_lines(documents(spark, rows), batches=batches, fanout=fanout).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_runs_are_compacted(spark):
    runs = LineRuns(2)
    for b in range(4):
        runs.add(spark.createDataFrame([(10 - b, bytes([k])) for k in range(b, b + 3)], "doc_id long, key binary"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    got = {r.key[0]: (r.n_docs, r.keeper) for r in runs.compacted().collect()}
    assert got == {0: (1, 10), 1: (2, 10), 2: (3, 10), 3: (3, 9), 4: (2, 8), 5: (1, 7)}


def test_text_and_empty_table(spark):
    line = "a line that is long enough"
    got = dedup_lines(documents(spark, [(d, f"{line}\nown {d}") for d in range(3)]).withColumnRenamed("lang", "key"), with_text=True)
    assert {r.doc_id: r.kept_text for r in got.collect()} == {0: "own 0", 1: "own 1", 2: f"{line}\nown 2"}
    assert dedup_lines(documents(spark, [])).count() == 0
    assert dedup_lines(documents(spark, [(None, line)])).first().n_dropped == 0


def test_runs_meet_without_a_shuffle(spark):
    runs = LineRuns(3)
    for b in range(2):
        runs.add(spark.createDataFrame([(10 - b, bytes([k])) for k in range(b, b + 3)], "doc_id long, key binary"))
    plan = runs.compacted()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.key[0], r.n_docs, r.keeper) for r in runs.compacted().collect()) == [(0, 1, 10), (1, 2, 10), (2, 2, 10), (3, 1, 9)]


@pytest.mark.parametrize("often", [1, 200, 100_000])
def test_rare_lines_merge_and_frequent_ones_are_broadcast(spark, often):
    rows = [(d, "\n".join([f"a line of every document {d % 2}"] + [f"a line of three documents {d // 3}, {k}" for k in range(70)])) for d in range(180)]
    rows += [(10**15, rows[0][1]), (None, rows[0][1]), (None, rows[4][1])]  # one id far away, two rows without
    got = dedup_lines(documents(spark, rows), often=often).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
