"""Temperature mixing of sources to target weights, native DataFrame operations only.

The sources' token shares p become weights p^t / sum(p^t). Bisection finds the
exponent t in [0, 1]: the smallest that repeats no source more often than a
limit, or the largest that reaches a target entropy. A source's part of the
token budget is then filled by whole passes over its documents and one partial
pass, in a permutation made of blocks: documents are dealt into blocks by a
hash, blocks follow each other in hashed order, and documents in a block in
hashed order. So no task orders more than one block, even of a source that
holds most of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.llm._common import ASCII_SPACE, written

#: Documents of a block on average; most rows that a broadcast table may have.
BLOCK, BROADCAST_ROWS = 10_000, 100_000
#: Halvings of [0, 1]; so many of them are decided by one job.
HALVINGS, AT_ONCE = 40, 5


def token_count(text: F.Column) -> F.Column:
    """Words between ASCII white space; null texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def exponent(shares: DataFrame, budget_share: float, max_repeats: float | None, entropy: float | None) -> float:
    """Bisect the exponent over ``shares`` (a row a source, column ``p``).

    ``entropy`` is a part of the largest possible one, log(sources). With both
    targets the larger exponent holds, so the repetition limit is kept.
    """

    def evaluate(points: list[float]) -> list:
        t = F.col("t")
        rows = shares.select("p", F.explode(F.array(*map(F.lit, points))).alias("t")).groupBy("t").agg(
            F.sum(F.pow("p", t)).alias("z"), F.sum(F.pow("p", t) * F.log("p")).alias("l"), F.min("p").alias("low"), F.count(F.lit(1)).alias("n"))
        return sorted(rows.collect(), key=lambda r: r.t)  # as many rows as points

    def repeats_fit(r) -> bool:
        return budget_share * r.low ** (r.t - 1) / r.z <= max_repeats

    def entropy_short(r) -> bool:
        return math.log(r.z) - r.t * r.l / r.z < entropy * math.log(r.n) - 1e-12

    found = []
    for wanted, test in ((max_repeats, repeats_fit), (entropy, entropy_short)):
        if wanted is None:
            continue
        low, high = 0.0, 1.0  # the test holds from some point on
        if test(evaluate([0.0])[0]):
            high = 0.0
        for _ in range(HALVINGS // AT_ONCE if high else 0):
            n = 1 << AT_ONCE
            points = [low + (high - low) * k / n for k in range(1, n)]
            first = next((k for k, r in enumerate(evaluate(points), 1) if test(r)), n)
            low, high = low + (high - low) * (first - 1) / n, low + (high - low) * first / n
        found.append(high)
    return max(found, default=1.0)


def mixed(docs: DataFrame, budget_share: float = 1.0, max_repeats: float | None = 2.0, entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """``row`` (all columns of ``docs``), ``doc_id, source, n_tokens, weight, copies`` for each row of ``docs``.

    The budget is ``budget_share`` of all tokens. ``copies`` is how often the
    mixture takes the row; a source takes at most its weight of the budget and
    less than one document fewer. Null sources are one source. Rows without
    tokens, null and empty texts among them, never count and get 0 copies;
    texts of any length are counted whole. Rows with equal or null ids are
    ordered by their text's hash; repeated rows count each. No rows give no rows.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("source"), token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("tie"))
    totals = written(rows.select("source", "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")), "totals")
    sources, total = totals.where("t > 0").agg(F.count(F.lit(1)), F.sum("t")).first()
    total = total or 0
    shares = totals.where("t > 0").withColumn("p", F.col("t") / F.lit(float(total or 1)))
    t = exponent(shares.select("p"), budget_share, max_repeats, entropy) if sources else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(t)))).first()[0] or 1.0
    plan = shares.select(
        F.col("source").alias("s"), F.col("t").alias("source_tokens"), (F.pow("p", F.lit(t)) / F.lit(z)).alias("weight"),
        F.ceil(F.col("n") / F.lit(float(BLOCK))).alias("blocks")).withColumn("quota", F.floor(F.col("weight") * F.lit(budget_share * total)).cast("long"))
    plan = _hinted(written(plan, "plan"), sources)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    planned = rows.withColumn("order", order).join(plan, rows.source.eqNullSafe(F.col("s")), "left").withColumn(
        "block", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.coalesce("blocks", F.lit(1)))
    blocks = planned.groupBy("source", "block").agg(F.sum("n_tokens").alias("b"))
    in_order = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "source", F.col("block").cast("string"))), "block")
    offsets = written(blocks.select(
        F.col("source").alias("o_source"), F.col("block").alias("o_block"), (F.sum("b").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")).alias("offset")), "offsets")
    offsets = _hinted(offsets, offsets.count())
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = planned.withColumn("inside", F.sum("n_tokens").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("block") == F.col("o_block")), "left")
    passes = F.floor(F.col("quota") / F.col("source_tokens")).cast("long")
    partial = (F.col("offset") + F.col("inside") <= F.col("quota") - passes * F.col("source_tokens")).cast("long")
    copies = F.when((F.col("n_tokens") > 0) & F.col("quota").isNotNull(), passes + partial).otherwise(0)
    return placed.select("row", "doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mixture: every row of ``docs`` as often as the plan takes it, with all its columns, whatever their names.

    Rows without tokens go; repeated rows count each; no rows give no rows.
    """
    return mixed(docs, **settings).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
