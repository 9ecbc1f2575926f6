"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, largest ``doc_id`` first. The keys that a batch
holds are merge-joined with the runs so far: what has no match is new, and
the batch's run records the new key with its keeper, the largest document
that holds it. A key that has a match adds its document count only. Two runs
of a level are compacted into one of the next, so that a key is rewritten
once a level instead of once a batch.

Runs are tables bucketed and sorted by key, all into the same buckets. A
batch is shuffled once, by its own keys; the runs that it meets and those
that are compacted are read bucket by bucket and never shuffled again. Their
files lie in the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import ASCII_SPACE, shared_folder, written

SPACE = ASCII_SPACE.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a stripped, lower-cased line; None if it has fewer than ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    size = len(key)
    if size < min_chars:
        return None
    if size < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys(min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, spread, keys = [], [], [], []
            for b, doc, part_of, text in zip(batch.column("batch").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("unnamed").to_pylist(), _texts(batch)):
                own = {line_key(line, min_chars) for line in text.split(b"\n")}
                own.discard(None)
                part += [b] * len(own)
                ids += [doc] * len(own)
                spread += [part_of] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(spread, pa.int64()), pa.array(keys, pa.binary())], ["batch", "doc_id", "unnamed", "key"])

    return work


def _apply(min_chars: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, sums, kept_texts = [], [], [], []
            for text, drop in zip(_texts(batch), batch.column("dropped_keys").to_pylist()):
                parts = text.split(b"\n")
                gone = set(drop or ())
                kept = [p for p in parts if line_key(p, min_chars) not in gone] if gone else parts
                joined = b"\n".join(kept)
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined)
            out = [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names)

    return work


class LineRuns:
    """Levelled sorted runs of ``(key, n_docs, keeper)``, a row for each key."""

    def __init__(self, fanout: int = 2) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _written(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a run: as many buckets as the session shuffles into, each sorted."""
        spark = rows.sparkSession
        buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"line_run_{uuid.uuid4().hex}"
        rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(table)
        return spark.table(table)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row a key. Runs are merged by joins, which keep to the buckets; a union of bucketed tables must not be grouped without a shuffle."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("key", F.col("n_docs").alias("_n"), F.col("keeper").alias("_k")).hint("merge")
            return a.join(b, "key", "full").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.coalesce(F.greatest("keeper", "_k"), "keeper", "_k").alias("keeper"))

        return reduce(merge, runs)

    def add(self, batch_keys: DataFrame) -> None:
        """Take in one batch of ``(doc_id, key)``, a row for each document and key."""
        own = batch_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = []
        for i, run in enumerate(self._all()):
            own = own.join(run.select("key", F.lit(True).alias(f"_in_{i}")).hint("merge"), "key", "left")
            known.append(F.col(f"_in_{i}").isNotNull())
        if known:
            own = own.withColumn("keeper", F.when(~reduce(lambda a, b: a | b, known), F.col("keeper")))
        self._push(0, self._written(own.select("key", "n_docs", "keeper"), "run-0"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, self._written(merged, f"run-{level + 1}"))

    def compacted(self) -> DataFrame:
        return self._merged(self._all())


def _batch(docs: DataFrame, batches: int):
    """The batch of a row: equal counts of rows, largest ids first, rows without an id last."""
    shares = [1 - b / batches for b in range(1, batches)]
    cuts = docs.approxQuantile("doc_id", shares, 0.01) if shares else []
    column = F.lit(batches - 1)
    for b, cut in reversed(list(enumerate(cuts))):
        column = F.when(F.col("doc_id") > int(cut), b).otherwise(column)
    return column


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, with_text: bool = False, often: int = 100_000) -> DataFrame:
    """Drop repeated lines from all documents but the one with the largest ``doc_id``.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` rows of ``docs`` hold lose their lines in every row but those
    of the largest ``doc_id`` holding it. Returns ``doc_id, n_lines, n_dropped,
    kept_sha256`` and, on demand, ``kept_text``; one row for each row of ``docs``.

    A null or empty text is one empty line. A null ``doc_id`` counts as the
    smallest, so such a row never keeps a line that a numbered row holds. Each
    row is a document: rows with the same ``doc_id`` count apart and share the
    keeper's right. Lines within a row count once, and the keeper keeps all of
    them. Texts of any length are split whole. No rows give no rows; other
    columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # rows without an id are told apart by their text, so that they are no group of their own
    docs = docs.withColumn("unnamed", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    rows = docs.select(_batch(docs, batches).cast("int").alias("batch"), "doc_id", "unnamed", "text")
    keys = written(rows.mapInArrow(_keys(min_chars), "batch int, doc_id long, unnamed long, key binary"), "keys", "batch")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    repeated = written(runs.compacted().where(F.col("n_docs") >= min_docs), "repeated")
    hot = F.col("n_docs") * often > keys.count()
    few = F.broadcast(repeated.where(hot).select("key", "keeper"))
    held = keys.select("doc_id", "unnamed", "key")
    both = held.join(few, "key").unionByName(held.join(few.select("key"), "key", "left_anti").join(repeated.where(~hot).select("key", "keeper").hint("merge"), "key"))
    drops = (
        both.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("unnamed").alias("drop_unnamed")).agg(F.collect_set("key").alias("dropped_keys"))
    )
    joined = docs.join(drops.hint("merge"), docs.doc_id.eqNullSafe(drops.drop_id) & docs.unnamed.eqNullSafe(drops.drop_unnamed), "left").select("doc_id", "text", "dropped_keys")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_apply(min_chars, with_text), schema)
