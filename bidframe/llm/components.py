"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import written
from bidframe.operators.joins import join_by_share


def _large_star(edges: DataFrame, total: int, often: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_share(both, least, ["u"], "n", 2 * total, often).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, often: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_by_share(edges, least, ["u"], "n", total, often).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, often: int = 100_000) -> DataFrame:
    """``(node, component)`` for every node of the undirected links ``(u, v)``; the component is its smallest node.

    A round moves every link closer to its smallest neighbour; rounds end when
    the links stay the same, after about log(longest path) rounds. Each round
    is written to the shared folder. Nothing but a count and a checksum of the
    links reaches the driver. A node that holds more than one in ``often``
    of all links is a hub, whose links need not meet in one task. Loops, repeated links and nulls are dropped; no
    links give no rows.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, "links")
    before = _signature(links)
    for _ in range(max_rounds):
        stars = written(_large_star(links, before[0], often), "stars")
        links = written(_small_star(stars, stars.count(), often), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
