"""Divergence of the sources of a language, with late string materialisation.

Terms are counted under 64-bit digests: only digests and counts are shuffled
for the counting, so a term costs the same whatever its length. Strings stay
in the table that the scan writes. Of the digests that are frequent enough to
matter, the smallest and the largest string are compared; where they differ,
two terms share a digest, and these digests alone are counted again by their
strings. The text of a term joins back for the terms of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: A-Z to lower case, letters and bytes above 127 as they are, all else a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms of all groups that a task counts before it writes them out.
ENTRIES = 250_000
#: Most rows of a broadcast table of digests or groups; beyond, the join sorts and merges.
BROADCAST_ROWS = 1_000_000
#: Sources that a tile of the pair comparison holds on average, its rows, and the terms compared at once.
TILE_SOURCES, BLOCK_ROWS, STRIP = 128, 16_384, 2_048
BILLION = 1_000_000_000


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def _scan(entries: int):
    def flushed(found: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in found.items():
            own = holders[lang, source]
            words = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array([counts[w] for w in words], pa.int64()), pa.array([own[w] for w in words], pa.int64())],
                ["lang", "source", "term", "n", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, holders, size = {}, {}, 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                words = terms(text.as_py())
                if not words:
                    continue
                key = lang, source
                if key not in found:
                    found[key], holders[key] = Counter(), Counter()
                size -= len(found[key])
                found[key].update(words)
                holders[key].update(set(words))
                size += len(found[key])
                if size >= entries:
                    yield from flushed(found, holders)
                    found, holders, size = {}, {}, 0
        yield from flushed(found, holders)

    return work


def _small(df: DataFrame) -> DataFrame:
    """A written table, with the hint that its size allows."""
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def count_terms(docs: DataFrame, min_docs: int = 30, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms that each language keeps, and the strings of their digests.

    The counts have a row ``lang, source, digest, own, n, lang_n`` for each
    group and kept term that occurs in it; ``own`` is the term where its digest
    is shared, else empty. The strings are ``digest, low, high``. Fewer
    ``digest_bits`` make collisions, which the result does not show.
    """
    digest = F.xxhash64("term") if digest_bits == 64 else F.pmod(F.xxhash64("term"), F.lit(1 << digest_bits))
    scanned = docs.mapInArrow(_scan(ENTRIES), "lang string, source string, term string, n long, docs long")
    found = written(scanned.withColumn("digest", digest), "terms")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    counts = written(found.groupBy("lang", "source", "digest").agg(*sums), "counts")

    # A digest's documents are at least those of each of its terms, so no kept term is lost here.
    often = written(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("digest").distinct(), "often")
    strings = found.select("digest", "term").join(_small(often), "digest", "left_semi").distinct()
    strings = written(strings.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "strings")
    shared = strings.where("low <> high").select("digest")
    entries = counts.withColumn("own", F.lit(""))
    if not shared.isEmpty():
        shared = _small(written(shared, "shared"))
        again = found.join(shared, "digest", "left_semi").groupBy("lang", "source", "digest", F.col("term").alias("own")).agg(*sums)
        entries = entries.join(shared, "digest", "left_anti").unionByName(again)

    key = ["lang", "digest", "own"]
    kept = entries.groupBy(*key).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= min_docs).drop("lang_docs")
    return written(entries.join(kept.hint("merge"), key).select("lang", "source", "digest", "own", "n", "lang_n"), "kept"), strings


def _share(count: F.Column, total: F.Column, kept: F.Column) -> F.Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 kept))`` in decimals; null if nothing is kept."""
    parts = F.lit(BILLION).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(5).cast("decimal(1,0)"))
    whole = total.cast("decimal(19,0)") + kept.cast("decimal(17,0)") * F.lit(5).cast("decimal(1,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", parts, whole))


def _differences(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of terms and two tiles of sources: each pair's differences, less those of terms that neither source has."""
    heads = rows[rows["digest"].isna()].sort_values(["tile", "source"], kind="stable")
    lang, left, right, block = (rows[c].iloc[0] for c in ("lang", "left", "right", "block"))
    names, bare, tile = heads["source"].to_list(), heads["p"].to_numpy(np.int64), heads["tile"].to_numpy()
    cells = rows[rows["digest"].notna()]
    place = cells["source"].map({s: k for k, s in enumerate(names)}).to_numpy(np.int64)
    number = cells.groupby(["digest", "own"], sort=False).ngroup().to_numpy(np.int64)
    order = np.argsort(number, kind="stable")
    place, number, share = place[order], number[order], cells["p"].to_numpy(np.int64)[order]
    n = len(names)
    base = np.abs(bare[:, None] - bare[None, :])
    total = base * int(heads["kept"].iloc[0]) if block == 0 else np.zeros((n, n), np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, STRIP):
        lo, hi = np.searchsorted(number, [start, start + STRIP])
        width = int(number[hi - 1]) - start + 1
        strip = np.repeat(bare[:, None], width, axis=1)
        strip[place[lo:hi], number[lo:hi] - start] = share[lo:hi]
        for a in range(n):
            total[a] += np.abs(strip - strip[a]).sum(axis=1)
        total -= base * width
    wanted = ~np.eye(n, dtype=bool) & ((tile[:, None] != tile[None, :]) | (left == right))
    a, b = np.nonzero(wanted)
    names = np.array(names, dtype=object)
    return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": total[a, b]})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for all sources of a language, compared tile by tile and block of terms by block."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("rows").alias("lang_rows"))
    tiles = F.ceil(F.col("sources") / TILE_SOURCES)
    per_block = F.greatest(F.lit(BLOCK_ROWS), F.pow(F.least("sources", F.lit(2 * TILE_SOURCES)), F.lit(2)))
    sizes = written(sizes.select("lang", tiles.cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / per_block)).cast("int").alias("blocks")), "sizes")
    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    heads = groups.join(_small(sizes), "lang").select(
        "lang", "source", F.lit(None).cast("long").alias("digest"), F.lit("").alias("own"), F.coalesce("bare", F.lit(0)).alias("p"), "kept", tile.alias("tile"),
        "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = shares.join(_small(sizes), "lang").select(
        "lang", "source", "digest", "own", "p", "kept", tile.alias("tile"), "tiles", F.pmod(F.xxhash64("digest", "own"), "blocks").cast("int").alias("block"))
    rows = heads.unionByName(cells).select("*", other.alias("other"))
    rows = rows.select("lang", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "block", "tile", "source", "digest", "own", "p", "kept")
    found = rows.groupBy("lang", "left", "right", "block").applyInPandas(_differences, "lang string, source string, item string, value long")
    return written(found, "differences").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50, digest_bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart, and by which terms.

    A language keeps the terms that at least ``min_docs`` of its rows hold.
    ``pair`` rows give, for each other source of the language, the summed
    difference of all kept terms' smoothed shares (parts of 10^9, exact
    integers); ``term`` rows the first ``top`` terms that a source has above
    its language's share. Ranks go by value descending, item ascending.

    Null texts, languages and sources are empty strings and one group with
    them. A group without terms and a language without kept terms have pairs
    all the same (value 0 for the latter). Repeated rows count each; texts of
    any length are read whole; a source alone in its language has no pair.
    Other columns, of any name, are ignored. No rows give no rows.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept, strings = count_terms(rows, min_docs, digest_bits)
    key = ["lang", "source"]
    of_lang = kept.groupBy("lang", "digest", "own").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    of_group = kept.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    groups = rows.select(*key).distinct().join(of_group.hint("merge"), key, "left").join(of_lang.hint("merge"), "lang", "left").fillna(0, ["total", "rows", "kept", "lang_total"])
    groups = written(groups.withColumn("bare", _share(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    shares = kept.join(_small(groups), key).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))

    pairs = _pairs(shares, groups).select(*key, F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item")))

    by_value = Window.partitionBy(*key).orderBy(F.desc("value"))
    above = shares.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("n > 0 AND value > 0").select(*key, "digest", "own", "value")
    above = written(above.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top).drop("place"), "above")
    named = above.join(strings.hint("merge"), "digest").withColumn("item", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("own")))
    words = named.select(*key, F.lit("term").alias("part"), "item", "value")
    words = words.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return pairs.unionByName(words)
