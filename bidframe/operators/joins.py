"""Joins whose keys are uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_share(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int, often: int = 100_000) -> DataFrame:
    """``rows`` inner joined with ``keyed``, one row a key, whose column ``n`` counts the key's rows in ``rows``.

    A key that holds more than one in ``often`` of the ``total`` rows is
    broadcast, so its rows stay where they are; there are fewer than ``often``
    such keys, whatever the size. All others are merged, and none of them can
    make a task large. Null keys match nothing, as in any inner join. ``n`` is
    kept; the columns of ``rows`` come first.
    """
    hot = F.col(n) * F.lit(often) > F.lit(total)
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(few.select(*on), on, "left_anti").join(keyed.where(~hot).hint("merge"), on)
    return rows.join(few, on).unionByName(rest)


def dealt(rows: DataFrame, key: str, total: int, most: int = 1_000_000) -> DataFrame:
    """``rows`` by ``key`` in tasks of about ``most`` of ``total`` rows, so the memory of a sort does not grow with the table.

    Adaptive execution puts partitions together by their compressed bytes,
    which for a few narrow columns are many millions of rows; a number that is
    given it leaves alone. Tables dealt with the same ``total`` meet without
    another shuffle.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-total // most)), key)


def small(table: DataFrame, most: int = 200_000) -> DataFrame:
    """``table`` with a broadcast hint where it has at most ``most`` rows, else with a merge hint; it is counted, so it should be a written table."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")
