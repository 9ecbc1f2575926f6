"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that may be close share a block: with radius r, two fingerprints
within r bits agree on one of r + 1 bands (exact), or, for large radii, share
a pair of minimum shingle hashes. Inside a block the bits are stored as
vertical planes, a word for 64 fingerprints. All distances of a block grow
together: each plane's mismatches enter carry-save counters that start so
that they overflow just beyond the radius, rows whose words have all
overflowed leave, and a block with no row left is abandoned. A block yields a
spanning forest of its links, so a group of m copies yields m - 1 rows.
Large blocks are cut into tiles and compared tile by tile.

``near_components`` takes close fingerprints for candidates only. Components of
candidates are gathered with their shingle sets, and the exact Jaccard
similarity decides inside them which candidates are linked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import written
from bidframe.llm.components import components

#: Rows of a tile, and rows that small blocks are gathered to before they are compared.
TILE, GATHER = 2048, 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle of the A-Z lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made of ``h`` (splitmix64 finaliser)."""
    z = h + np.uint64(_GOLDEN * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit for each bit position that over half of the hashes set; zero without hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    out = b""
    for k in range(bits // 64):
        h = mixed(hashes, k) if k else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 17):
            by = h[at : at + (1 << 17)].astype(">u8").view(np.uint8).reshape(-1, 8) + _LANES
            counts += (np.bincount(by.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        out += np.packbits(2 * counts > len(h)).tobytes()
    return out


_LANES = (np.arange(8) * 256).astype(np.int64)


def min_blocks(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band: a hash of the minima of ``rows`` hash functions."""
    if not len(hashes):
        return [0]
    mins = [mixed(hashes, 1000 + k).min() for k in range(bands * rows)]
    return [xxhash.xxh64_intdigest(b"%d:" % b + np.array(mins[b * rows : (b + 1) * rows]).tobytes()) - (1 << 63) for b in range(bands)]


def _prints(shingle: int, bits: int, distinct: bool, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, blocks, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                h = shingle_hashes(text.as_py() or b"", shingle)
                h = np.unique(h) if distinct else h
                prints.append(simhash(h, bits).hex())
                blocks.append(min_blocks(h, bands, rows) if bands else [])
                counts.append(len(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints, pa.string()), pa.array(blocks, pa.list_(pa.int64())), pa.array(counts, pa.int64())],
                ["doc_id", "text_key", "fingerprint", "blocks", "shingles"])

    return work


def close_rows(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``prints`` (m x bytes, uint8) that have later rows within ``radius`` bits, and these as bits in words."""
    m = len(prints)
    width = -(-m // 64)
    bits = np.unpackbits(prints, axis=1)
    padded = np.zeros((bits.shape[1], width * 64), np.uint8)
    padded[:, :m] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    slices = max(1, int(radius + 1).bit_length())
    start = (1 << slices) - (radius + 1)
    rows = np.arange(m)
    later = np.arange(width * 64)[None, :] > rows[:, None]
    later[:, m:] = False
    over = ~np.packbits(later, axis=1, bitorder="little").view(np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full((m, width), ones if start >> k & 1 else np.uint64(0)) for k in range(slices)]
    for b in range(len(planes)):
        carry = planes[b][None, :] ^ np.where(bits[rows, b], ones, np.uint64(0))[:, None]
        for k in range(slices):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            alive = (over != ones).any(axis=1)
            if not alive.all():
                if not alive.any():
                    return np.empty(0, np.int64), np.empty((0, width), np.uint64)
                rows, over = rows[alive], over[alive]
                counters = [c[alive] for c in counters]
    return rows, ~over


def _pairs(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def close_pairs(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of ``close_rows``."""
    return _pairs(*close_rows(prints, radius))


def forest(m: int, rows: np.ndarray, words: np.ndarray, at_once: int = 128) -> np.ndarray:
    """The smallest row that each of ``m`` rows reaches; links are unpacked for ``at_once`` rows at a time."""
    label = np.arange(m)
    while len(rows):
        before = label.copy()
        for at in range(0, len(rows), at_once):
            i, j = _pairs(rows[at : at + at_once], words[at : at + at_once])
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def of_like_size(rows: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``words`` without the links whose numbers of shingles exclude a Jaccard similarity of 0.8."""
    out = np.empty_like(words)
    for at in range(0, len(rows), 128):
        own = size[rows[at : at + 128]][:, None]
        bits = np.unpackbits(words[at : at + 128].view(np.uint8), axis=1, bitorder="little")
        bits[:, : len(size)] &= 5 * np.minimum(own, size) >= 4 * np.maximum(own, size)
        out[at : at + 128] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def _links(radius: int, sized: bool = False):
    columns = ["cell", "node", "fingerprint", *["shingles"] * sized]

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        ids = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        data = np.frombuffer(bytes.fromhex("".join(r[1] for r in rows)), np.uint8).reshape(len(rows), -1)[order]
        close, words = close_rows(data, radius)
        if sized:
            words = of_like_size(close, words, np.array([r[2] for r in rows], np.int64)[order])
        label = forest(len(ids), close, words)
        moved = ids[label] != ids
        return ids[moved].tolist(), ids[label][moved].tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of whole blocks
        last = None  # the block being read

        def out() -> pa.RecordBatch:
            u, v = compare(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if cell != last:
                    if len(held) >= GATHER:
                        yield out()
                    last = cell
                held.append(row)
        if held:
            yield out()

    return work


def _cells(blocks: DataFrame) -> DataFrame:
    """``blocks`` of two nodes and more with ``cell``, a pair of tiles of a block."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    return (
        blocks.join(sizes.hint("merge"), "block")
        .withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("cell", F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other"))).drop("block", "m", "tiles", "tile", "other")
    )


def links(blocks: DataFrame, radius: int) -> DataFrame:
    """Links ``(u, v)`` that span the same components as all pairs within ``radius`` bits in a block.

    ``blocks`` has ``block`` (any type), ``node`` long and ``fingerprint`` hex,
    a row for each node and block. Blocks of more than ``TILE`` nodes are cut
    into tiles by a hash of the fingerprint; every pair of tiles is a cell.
    """
    rows = _cells(blocks).select("cell", "node", "fingerprint")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "u long, v long")


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, distinct: bool = False, bands: int = 0, rows: int = 2) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``fingerprint`` (hex), minimum-hash ``blocks`` and the number of ``shingles``, written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    return written(docs.mapInArrow(_prints(shingle, bits, distinct, bands, rows), "doc_id long, text_key long, fingerprint string, blocks array<long>, shingles long"), "prints")


def _shingle_sets(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # sets are larger than their texts
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)).view(np.int64) for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("component"), pa.array(sets, pa.list_(pa.int64()))], ["node", "component", "set"])

    return work


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share (above the diagonal)."""
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.nonzero(np.concatenate(([True], values[1:] != values[:-1])))[0] if len(values) else np.empty(0, np.int64)
    sizes = np.diff(np.append(cuts, len(values)))
    counts = np.zeros(m * m)
    for k in range(2, min(16, m) + 1):  # elements of few sets: pair by pair
        at = cuts[sizes == k]
        if len(at):
            own = owner[at[:, None] + np.arange(k)]
            for i, j in itertools.combinations(range(k), 2):
                counts += np.bincount(own[:, i] * m + own[:, j], minlength=m * m)
    counts = counts.reshape(m, m)
    many = np.nonzero(sizes > 16)[0]
    for at in range(0, len(many), 2048):  # elements of many sets: as products of a membership table
        part = many[at : at + 2048]
        rows = np.repeat(np.arange(len(part)), sizes[part])
        places = np.repeat(cuts[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(sizes[part].sum())
        table = np.zeros((m, len(part)), np.float32)
        table[owner[places], rows] = 1
        counts += table @ table.T
    return counts


def similar_labels(sets: list[np.ndarray], blocks: list[np.ndarray] | None = None) -> np.ndarray:
    """The first set that each set reaches over links of a Jaccard similarity of 0.8 or more; with ``blocks``, only sets that share one are linked."""
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        near = 9 * shared >= 4 * size.sum() and (blocks is None or len(np.intersect1d(*blocks, assume_unique=True)) > 0)
        return np.array([0, 0 if near else 1])
    linked = np.triu(9 * shared_counts(sets) >= 4 * (size[:, None] + size), 1)
    if blocks is not None:
        linked &= shared_counts(blocks) > 0
    width = -(-len(sets) // 64) * 64
    bits = np.zeros((len(sets), width), np.uint8)
    bits[:, : len(sets)] = linked
    return forest(len(sets), np.arange(len(sets)), np.packbits(bits, axis=1, bitorder="little").view(np.uint64))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, node, set, blocks)`` by part and node; out come the links ``(u, v)`` of each node to the first one it reaches. Null ``blocks``: all pairs share one."""
    last, nodes, sets, held = None, [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            ids = np.array(nodes, np.int64)
            label = similar_labels(sets, held if held[0] is not None else None)
            moved = label != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label][moved])], ["u", "v"])

    for batch in batches:
        column = batch.column("set")
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        for part, node, own, a, z in zip(batch.column("part").to_pylist(), batch.column("node").to_pylist(), batch.column("blocks").to_pylist(), [0, *ends], ends):
            if part != last:
                yield from out()
                last, nodes, sets, held = part, [], [], []
            nodes.append(node)
            sets.append(flat[a:z].copy())
            held.append(None if own is None else np.array(own, np.int64))
    yield from out()


def _verify(rows: DataFrame) -> DataFrame:
    return written(rows.select("part", "node", "set", "blocks").repartition("part").sortWithinPartitions("part", "node").mapInArrow(_verified, "u long, v long"), "verified")


def similar_components(docs: DataFrame, blocks: DataFrame, shingle: int, radius: int) -> DataFrame:
    """``(node, component)`` of the links of exact Jaccard 0.8 or more among candidates that share a block; nodes without links are left out.

    ``blocks`` has ``block``, ``node``, ``fingerprint`` and ``shingles``; the
    ids of ``docs`` are nodes. Nodes of a block are candidates if their
    fingerprints lie within ``radius`` bits and their numbers of shingles allow
    0.8. A component of candidates of at most ``TILE`` nodes meets in one task
    with its shingle sets. Of a larger one the nodes meet block by block, by
    pairs of tiles, and the links of all blocks give the components. In both
    cases the pairs that share a block are judged, so a component's size does
    not change what is linked.
    """
    cells = written(_cells(blocks), "cells")
    close = cells.select("cell", "node", "fingerprint", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius, True), "u long, v long")
    maybe = written(components(written(close, "close")), "maybe")
    sizes = written(maybe.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "sizes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("text")).join(maybe.hint("merge"), "node")
    sets = written(texts.select("node", "component", "text").mapInArrow(_shingle_sets(shingle), "node long, component long, set array<long>"), "sets")
    small = sets.join(sizes.where(F.col("m") <= TILE).hint("merge"), "component", "left_semi")
    own = blocks.join(maybe.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.collect_set(F.xxhash64("block")).alias("blocks"))
    links = _verify(small.join(own.hint("merge"), "node").withColumn("part", F.col("component")))
    large = sizes.where(F.col("m") > TILE).select("component")
    if not large.isEmpty():
        hot = sets.join(large.hint("merge"), "component", "left_semi")
        by_cell = components(_verify(cells.select(F.col("cell").alias("part"), "node").join(hot.hint("merge"), "node").withColumn("blocks", F.lit(None).cast("array<long>"))))
        links = links.unionByName(by_cell.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def band_blocks(classes: DataFrame, bits: int, radius: int) -> DataFrame:
    """A row for each class and each of the radius + 1 bands of hex digits."""
    digits, n = bits // 4, radius + 1
    if n > digits:
        raise ValueError("more bands than hex digits; use minimum-hash blocks")
    edges = [digits * k // n for k in range(n + 1)]
    keys = F.array(*(F.concat(F.lit(f"{k}:"), F.substring("fingerprint", a + 1, b - a)) for k, (a, b) in enumerate(zip(edges, edges[1:]))))
    return classes.select(F.explode(keys).alias("block"), "node", "fingerprint")


def _labelled(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    of_class = classes.join(found.hint("merge"), "node", "left").select(F.col("fingerprint").alias("class_print"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(of_class.hint("merge"), prints.fingerprint == F.col("class_print")).select("doc_id", "fingerprint", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 2) -> DataFrame:
    """Fingerprint of each document and the component of documents it belongs to.

    A fingerprint bit is 1 if over half of the text's shingle hashes set it;
    shingles are ``shingle`` words long (fewer words: the whole sequence; none:
    fingerprint zero). Fingerprints within ``radius`` bits are linked; all such
    links are found. Returns ``doc_id, fingerprint, component_id``, a row for
    each row of ``docs``; the component is its smallest ``doc_id``.

    Null texts count as empty. Rows with a null ``doc_id`` belong to the
    component of the rows with equal fingerprint; if all of these lack an id,
    the component is null. Repeated rows stay. Texts of any length are read
    whole; other columns of ``docs``, of any name, are ignored. No rows give no
    rows.
    """
    prints = fingerprints(docs, shingle, bits)
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "classes")
    close = links(band_blocks(classes.where("node IS NOT NULL"), bits, radius), radius)
    return _labelled(prints, classes, components(written(close, "close")))


def _near_labels(docs: DataFrame, shingle: int, bits: int, radius: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, fingerprint, component`` (a number) for each row of ``docs``."""
    prints = fingerprints(docs, shingle, bits, True, bands, rows)
    own = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("own")
    classes = prints.groupBy("fingerprint").agg(own, F.first("blocks").alias("blocks"), F.first("shingles").alias("shingles"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "fingerprint", "own.doc_id", "own.text_key", "blocks", "shingles"), "classes")
    keys = classes.select("node", F.col("doc_id").alias("d"), F.col("text_key").alias("k")).hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    texts = texts.join(keys, texts.doc_id.eqNullSafe(F.col("d")) & (F.xxhash64(texts.text) == F.col("k"))).select(F.col("node").alias("doc_id"), "text")
    found = written(similar_components(texts, classes.select(F.explode("blocks").alias("block"), "node", "fingerprint", "shingles"), shingle, radius), "found")
    labels = classes.join(found.hint("merge"), "node", "left").select(F.col("fingerprint").alias("f"), F.coalesce("component", "node").alias("component"))
    return prints.join(labels.hint("merge"), prints.fingerprint == F.col("f")).select("doc_id", "text_key", "fingerprint", "component")


def near_components(docs: DataFrame, shingle: int = 5, bits: int = 512, radius: int = 150, bands: int = 8, rows: int = 2) -> DataFrame:
    """Components of the documents linked by a Jaccard similarity of 0.8 or more of their ``shingle``-word shingles.

    Candidates share ``rows`` minimum shingle hashes and have fingerprints
    within ``radius`` bits; each link is verified by the exact similarity (see
    ``similar_components``). The fingerprint is over distinct shingles. At
    ``bits`` = 512 and Jaccard 0.8 its distance is 78 bits for many shingles
    and at most 96 (4 against 5 shingles, where an even and an odd number of
    them shift the majority); 150 bits lie six standard deviations above that.
    Two texts of similarity s miss every block with probability
    (1 - s^rows)^bands, 0.0003 at 0.8. Texts of equal fingerprint are one node.
    Returns ``doc_id, fingerprint, component_id`` as ``simhash_components`` does.
    """
    found = written(_near_labels(docs, shingle, bits, radius, bands, rows), "labels")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least.hint("merge"), "component").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, bits: int = 512, radius: int = 150, bands: int = 8, rows: int = 2) -> DataFrame:
    """One row of each group of near copies (see ``near_components``), with all its columns, whatever their names.

    The row with the smallest ``doc_id`` stays; null ids come last, and of
    equal ids the text with the smallest hash is first, so no text is lost to
    another one of the same id. Repeated rows are copies. Null and empty texts
    are copies of each other. Texts of any length are read whole. No rows give
    no rows.
    """
    found = _near_labels(docs, shingle, bits, radius, bands, rows)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("own"))
    kept = written(kept.select(F.col("own.doc_id").alias("keep_id"), F.col("own.text_key").alias("keep_key")), "kept").hint("merge")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    whole = whole.join(kept, whole.id.eqNullSafe(F.col("keep_id")) & (whole.key == F.col("keep_key")), "left_semi")
    return whole.dropDuplicates(["id", "key"]).select("row.*")
