from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from bidframe.llm.components import components
from bidframe.llm.simhash import close_pairs, close_rows, drop_near_copies, forest, near_components, simhash_components

from .helpers import documents


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_close_pairs_match_brute_force(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    rows = np.concatenate([base, base, base])
    for r in rows[40:]:
        for b in rng.integers(0, 64, rng.integers(0, 12)):
            r[b // 8] ^= np.uint8(1 << (b % 8))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if int(np.unpackbits(rows[i] ^ rows[j]).sum()) <= radius}
    assert set(zip(*(x.tolist() for x in close_pairs(rows, radius)))) == want


@pytest.mark.parametrize("at_once", [1, 7, 128])
def test_forest_matches_brute_force(at_once):
    rng = np.random.default_rng(8)
    prints = np.repeat(rng.integers(0, 256, (30, 8), dtype=np.uint8), 5, axis=0)
    for r in prints:
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            r[b // 8] ^= np.uint8(1 << (b % 8))
    prints = prints[rng.permutation(150)]
    want = brute_components({i: int.from_bytes(r.tobytes(), "big") for i, r in enumerate(prints)}, 3)
    assert dict(enumerate(forest(150, *close_rows(prints, 3), at_once).tolist())) == want


def test_operator_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    for t in texts[:60]:
        w = t.split() or ["x"]
        w[rng.randrange(len(w))] = "Other"
        texts.append(" ".join(w))
    texts += ["", "", "one", "ONE", "two words", "a  b\tc", "A b c", texts[0] * 200, texts[1]]
    rows = list(enumerate(texts)) + [(900, None), (901, texts[5]), (901, texts[5])]
    got = simhash_components(documents(spark, rows), 3, 64, 2).collect()
    assert len(got) == len(rows)
    prints = {d: brute_print(t) for d, t in rows}
    want = brute_components(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_large_blocks_are_tiled(spark, monkeypatch):
    import bidframe.llm.simhash as module

    monkeypatch.setattr(module, "TILE", 8)
    blocks = spark.createDataFrame([("b", i, f"{i % 40:016x}") for i in range(120)], "block string, node long, fingerprint string")
    found = {r.node: r.component for r in components(module.links(blocks, 1)).collect()}
    want = brute_components({i: i % 40 for i in range(120)}, 1)
    assert found == want


def test_edge_cases(spark):
    empty = simhash_components(documents(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
    got = {(r.doc_id, r.component_id) for r in simhash_components(documents(spark, [(None, "a b c"), (7, "a b c"), (None, "q r s t")])).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_near_copies_go(spark):
    rng = random.Random(7)
    rows, words = [], [f"v{k}" for k in range(5000)]
    for d in range(40):
        rows.append((d, " ".join(rng.choice(words) for _ in range(200))))
    for d in range(40, 60):
        w = rows[d - 40][1].split()
        w[rng.randrange(200)] = "changed"
        rows.append((d, " ".join(w)))
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, "free text")]
    docs = documents(spark, rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(40))
    found = {r.doc_id: r.component_id for r in near_components(docs).collect()}
    assert all(found[d] == d - 40 for d in range(40, 60))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (100, 101)], "u long, v long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def shingled(text, size=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def test_links_are_those_of_exact_similarity(spark):
    rng = random.Random(11)
    texts, words = [], [f"w{k}" for k in range(9000)]
    for _ in range(40):  # 4 against 5 shingles, Jaccard 0.8
        w = [rng.choice(words) for _ in range(9)]
        texts += [" ".join(w), " ".join(w[:8])]
    for extra in (50, 60, 65, 66, 75):  # a text within another: 0.8, 0.77, 0.75, 0.75, 0.73 and chains of these
        for _ in range(12):
            w = [rng.choice(words) for _ in range(204 + 2 * extra)]
            texts += [" ".join(w[:204]), " ".join(w[: 204 + extra]), " ".join(w)]
    sets = dict(enumerate(map(shingled, texts)))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_components(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {d: find(d) for d in sets}


def test_rejected_candidates_are_replaced_by_others(spark):
    from bidframe.llm.simhash import similar_components

    rng = random.Random(12)
    base, texts = [f"u{k}" for k in range(104)], {}
    for group in range(4):  # groups at similarity 0.7 of one another, members at 0.9
        w = list(base)
        w[10 * group + 5 : 10 * group + 13] = [f"g{group}-{k}" for k in range(8)]
        for member in range(5):
            texts[4 * member + group] = " ".join([*w, *(f"m{group}-{member}-{k}" for k in range(3))])
    sets = {d: shingled(t) for d, t in texts.items()}
    for i in sets:
        for j in range(i):
            assert (9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))) == (i % 4 == j % 4)
    print_ = rng.randbytes(64).hex()
    blocks = spark.createDataFrame([(b, d, print_, len(s)) for b in (1, 2) for d, s in sets.items()], "block long, node long, fingerprint string, shingles long")
    found = {r.node: r.component for r in similar_components(documents(spark, list(texts.items())), blocks, 5, 150).collect()}
    assert found == {d: d % 4 for d in texts}


def test_shared_counts():
    from bidframe.llm.simhash import shared_counts, similar_labels

    rng = np.random.default_rng(3)
    for m, top in ((2, 40), (5, 60), (40, 80), (90, 300)):
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 120))) for _ in range(m)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert (np.triu(shared_counts(sets), 1) == np.triu(want, 1)).all()
        links = {i: i for i in range(m)}
        for _ in range(m):
            for i in range(m):
                for j in range(m):
                    if 9 * want[i][j] >= 4 * (len(sets[i]) + len(sets[j])):
                        links[i] = links[j] = min(links[i], links[j])
        assert similar_labels(sets).tolist() == [links[i] for i in range(m)]


def test_large_candidate_components(spark, monkeypatch):
    import bidframe.llm.simhash as module

    monkeypatch.setattr(module, "TILE", 6)
    rng = random.Random(13)
    base = [f"u{k}" for k in range(120)]
    texts = {}
    for d in range(40):  # families at a similarity of about 0.75 of one another
        w = list(base)
        family = d % 4
        w[20 * family : 20 * family + 6] = [f"f{family}-{k}" for k in range(6)]
        w[rng.randrange(100, 120)] = f"own{d}"
        texts[d] = " ".join(w)
    sets = {d: shingled(t) for d, t in texts.items()}
    label = {d: d for d in sets}
    for _ in range(40):
        for i in sets:
            for j in sets:
                if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    label[i] = label[j] = min(label[i], label[j])
    assert 1 < len(set(label.values())) < 40
    got = {r.doc_id: r.component_id for r in near_components(documents(spark, list(texts.items())), bands=24, rows=1).collect()}
    assert got == label


def test_rows_that_share_an_id_are_not_lost(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "q r s t u v"), (1, "q r s t u v"), (None, "a b c d e f"), (None, "x y z"), (2, None), (3, "")]).withColumnRenamed("lang", "node").withColumnRenamed("source", "component")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (1, "q r s t u v"), (None, "x y z"), (2, None)], key=str)
    assert drop_near_copies(documents(spark, [])).count() == 0


def test_component_size_does_not_change_links(spark, monkeypatch):
    """Similar nodes without a common block are not linked, in a small component as in a large one."""
    import bidframe.llm.simhash as module

    base = [f"u{k}" for k in range(200)]
    texts = {d: " ".join([*base[:d], f"own{d}", *base[d + 1 :]]) for d in range(12)}
    sparse = {d: " ".join(w if k % 9 else f"s{d}-{k}" for k, w in enumerate(base)) for d in (20, 21)}  # linked to nothing, but they join the candidates
    texts |= sparse
    print_ = random.Random(3).randbytes(64).hex()
    member = [(1, d) for d in range(6)] + [(2, d) for d in range(6, 12)] + [(3, 0), (3, 20), (4, 20), (4, 6)]
    blocks = spark.createDataFrame([(b, d, print_, len(shingled(texts[d]))) for b, d in member], "block long, node long, fingerprint string, shingles long")
    got = []
    for tile in (2048, 4):
        monkeypatch.setattr(module, "TILE", tile)
        got.append({r.node: r.component for r in module.similar_components(documents(spark, list(texts.items())), blocks, 5, 150).collect()})
    assert got[0] == got[1] == {d: 0 if d < 6 else 6 for d in range(12)}


@pytest.mark.parametrize("often", [1, 5, 100_000])
def test_components_with_hubs(spark, often):
    """Two stars joined by a chain, a star whose hub is its largest node, a ring; hubs are broadcast or merged alike."""
    links = [(5, k) for k in range(100, 160)] + [(170, k) for k in range(159, 170)] + [(900, k) for k in range(800, 840)] + [(k, k % 7 + 301) for k in range(301, 308)]
    nodes = {n for link in links for n in link}
    label = {n: n for n in nodes}
    for _ in nodes:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), often=often).collect()}
    linked = {n for u, v in links if u != v for n in (u, v)}
    assert got == {n: label[n] for n in linked}
