"""The pipeline's stages on planted cases."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline

from .helpers import documents


def corpus(rng):
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "sun", "gri") for b in ("na", "sto", "ri", "lu", "men", "ko", "pel")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels, role = [], [], {}
    bench = [(i, text(30)) for i in range(5)]
    for d in range(400):
        toxic = rng.random() < 0.25
        t = text(rng.randint(60, 160))
        if toxic:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
            t = " ".join(w)
        rows.append((d, t))
        labels.append((d, 1, int(toxic)))
        role[d] = "toxic" if toxic else "clean"
    clean = [r for r in rows if role[r[0]] == "clean"]
    for k in range(20):
        w = clean[k][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w) if k % 2 else clean[k][1]))
        role[1000 + k] = "copy"
        rows.append((2000 + k, text(40) + " " + bench[k % 5][1] + " " + text(20)))
        role[2000 + k] = "leak"
    return rows, labels, bench, role


def test_stages(spark, tmp_path):
    rows, labels, bench, role = corpus(random.Random(11))
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    of = defaultdict(set)
    for d, r in role.items():
        of[r].add(d)

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    kept = stage["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert len(ids(kept) & of["toxic"]) <= 0.1 * len(of["toxic"]) and len(of["clean"] - ids(kept)) <= 0.02 * len(of["clean"])
    kept = stage["simhash near-dedup"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == set(role) - of["copy"]
    kept = stage["benchmark decontamination"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == set(role) - of["leak"]
    kept = stage["mixing"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and 0.7 * len(rows) < kept.count() <= len(rows)
    assert ids(stage["sharding"](spark, docs, str(tmp_path))) == set(role)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert final and not {r.doc_id for r in final} & (of["copy"] | of["leak"])
    by_shard = defaultdict(list)
    for r in final:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
