"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A group is all rows with one text. Groups are dealt into cells of bounded
size; each cell differences its groups into one partial partition of k sums.
The partial partitions of the cells are then differenced with each other,
``FAN_IN`` at a time, until one is left. Differencing always combines the two
partial partitions with the largest spread, the largest sum of one with the
smallest of the other. Hence a task holds at most one cell of groups or
``FAN_IN`` partial partitions, whatever the size of the input.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: Groups of a cell on average, partial partitions combined at a time, rows of a numbering block on average.
CELL, FAN_IN, BLOCK = 20_000, 1024, 100_000


def difference(parts: list[list[tuple[int, int]]], k: int) -> list[list[int]]:
    """Combine partial partitions, lists of at most ``k`` (sum, label), to one.

    Returns for each of the k places of the result the labels that it holds,
    places in descending order of their sums.
    """
    children: list[tuple[int, int]] = []  # of the nodes that a combination made

    def join(a: int, b: int) -> int:
        children.append((a, b))
        return -len(children)

    heap, entries = [], []
    for part in parts:
        part = sorted(((s, label) for s, label in part if s), key=lambda x: (-x[0], x[1]))[:k] or [(0, part[0][1])]
        low = part[-1][0] if len(part) == k else 0
        heapq.heappush(heap, (low - part[0][0], len(entries)))
        entries.append(part)
    while len(heap) > 1:
        a = entries[heapq.heappop(heap)[1]]
        b = entries[heapq.heappop(heap)[1]]
        extra = len(a) + len(b) - k
        if extra <= 0:
            made = list(heapq.merge(a, b, key=lambda x: -x[0]))
        else:  # the last `extra` of each, largest with smallest, share places
            shared = [(x[0] + y[0], join(x[1], y[1])) for x, y in zip(a[len(a) - extra :], reversed(b[len(b) - extra :]))]
            made = sorted([*a[: len(a) - extra], *b[: len(b) - extra], *shared], key=lambda x: -x[0])
        heapq.heappush(heap, ((made[-1][0] if len(made) == k else 0) - made[0][0], len(entries)))
        entries.append(made)
    final = entries[heap[0][1]] if heap else []
    places = []
    for _, node in final:
        stack, labels = [node], []
        while stack:
            x = stack.pop()
            if x < 0:
                stack += children[-x - 1]
            else:
                labels.append(x)
        places.append(labels)
    return places


def _within(k: int):
    def work(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group_key", kind="stable").reset_index(drop=True)
        sizes = rows["bytes"].tolist()
        places = difference([[(s, i)] for i, s in enumerate(sizes)], k)
        place = [0] * len(sizes)
        for p, labels in enumerate(places):
            for i in labels:
                place[i] = p
        return pd.DataFrame({"cell": cell[0], "group_key": rows["group_key"], "place": place, "bytes": sizes})

    return work


def _across(k: int):
    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "place"], kind="stable").reset_index(drop=True)
        parts = [list(zip(own["bytes"].tolist(), own.index.tolist())) for _, own in rows.groupby("part", sort=True)]
        place = [0] * len(rows)
        for p, labels in enumerate(difference(parts, k)):
            for i in labels:
                place[i] = p
        rows["wider"], rows["new_place"] = key[0], place
        return rows[["part", "place", "bytes", "wider", "new_place"]]

    return work


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``group_key, shard`` for ``groups`` of ``group_key`` (binary, unique) and ``bytes`` (long, positive)."""
    n = groups.count()
    cells = max(1, -(-n // CELL))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("group_key"), F.lit(cells)).cast("int"))
    local = written(dealt.groupBy("cell").applyInPandas(_within(shards), "cell int, group_key binary, place int, bytes long"), "local")
    parts = written(local.groupBy("cell", "place").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("cell", "part"), "parts")
    where = parts.select(F.col("part").alias("cell"), F.col("place").alias("first_place"), "part", "place")
    while cells > 1:
        cells = -(-cells // FAN_IN)
        moved = written(
            parts.withColumn("wider", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("wider")
            .applyInPandas(_across(shards), "part int, place int, bytes long, wider int, new_place int"), "moved")
        where = written(
            where.join(moved.drop("bytes").hint("merge"), ["part", "place"])
            .select("cell", "first_place", F.col("wider").alias("part"), F.col("new_place").alias("place")), "where")
        parts = written(moved.groupBy(F.col("wider").alias("part"), F.col("new_place").alias("place")).agg(F.sum("bytes").alias("bytes")), "parts")
    return local.join(where.select("cell", F.col("first_place").alias("place"), F.col("place").alias("shard")).hint("merge"), ["cell", "place"]).select("group_key", "shard")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; rows with equal texts share a shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row
    for each row of ``docs``. ``size`` is the UTF-8 bytes of the text plus 16;
    ``slot`` counts each shard's rows from 0 without gaps. The law is
    ``bytes``, so ``grown_shard`` is null.

    A null text has no bytes and shares the group of the empty text. Null and
    repeated ids and repeated rows each get a slot. A group beyond a shard's
    fair part is alone as far as the sums allow. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group_key")), "sizes")
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    placed = rows.join(group_shards(groups.select("group_key", "bytes"), shards).hint("merge"), "group_key")
    total = groups.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (shards * BLOCK)))
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(blocks))), "placed")
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "block", before.alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "group_key"))
    return placed.withColumn("number", number).join(starts.hint("merge"), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
