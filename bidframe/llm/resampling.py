"""Importance resampling towards a target distribution, with hashed n-grams.

A piece of text is scanned by an Aho-Corasick automaton over its distinct
words. Each word stands between blanks, so only whole words match, and carries
the number of its payload: the CRC-32 of the word and its length. The CRC of a
run of words follows from those of its parts, since the CRC of a text followed
by another is the first one shifted by the other's length, plus the other one.
So a feature's bucket is composed from the payloads of adjacent words, and no
n-gram is ever built as a string.

The scan writes each document's buckets once. Counting and scoring read these
numbers instead of the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: A-Z to lower case, digits, letters and bytes above 127 as they are, all else a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that one automaton serves; a longer text is scanned in pieces cut between words.
PIECE = 8 << 20
#: The reversed polynomial of CRC-32; fixed value.
POLYNOMIAL = 0xEDB88320
_BLANK = zlib.crc32(b" ")


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix (a column for each bit) times each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """The matrix that moves a CRC past 2^k zero bytes."""
    if k:
        half = _power(k - 1)
        return _times(half, half)
    one_bit = np.array([POLYNOMIAL, *(1 << np.arange(31))], np.uint32)
    byte = one_bit
    for _ in range(3):
        byte = _times(byte, byte)
    return byte


@lru_cache(maxsize=4_096)
def shift_table(length: int) -> np.ndarray:
    """Four tables, one for each byte of a CRC, that move it past ``length`` zero bytes."""
    matrix, k = (1 << np.arange(32)).astype(np.uint32), 0
    while length >> k:
        if length >> k & 1:
            matrix = _times(_power(k), matrix)
        k += 1
    digits = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, digits << np.uint32(8 * b)) for b in range(4)])


def _shifted(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Each CRC moved by the table of its number."""
    out = tables[which, 0, crc & np.uint32(255)]
    for b in range(1, 4):
        out ^= tables[which, b, (crc >> np.uint32(8 * b)) & np.uint32(255)]
    return out


class Dictionary:
    """The automaton over the distinct words of some text, and the payloads that it emits."""

    def __init__(self, words: set[bytes]) -> None:
        own = list(words)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(own):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        if own:
            self.automaton.make_automaton()
        sizes, self.length = np.unique(np.array([len(w) for w in own], np.int64), return_inverse=True)
        self.crc = np.array([zlib.crc32(w) for w in own], np.uint32)
        self.tables = np.stack([shift_table(int(s)) for s in sizes]) if own else np.zeros((0, 4, 256), np.uint32)

    def scan(self, text: bytes) -> np.ndarray:
        """The numbers of the words of a text that begins and ends with a blank."""
        return np.array([number for _, number in self.automaton.iter(text.decode("latin-1"))], np.int64)


def compose(words: Dictionary, seen: np.ndarray, longest: int) -> list[np.ndarray]:
    """CRCs of all runs of 1 to ``longest`` adjacent words, by length of run; the k-th array begins a run of k + 1 words at each word."""
    crc, length = words.crc[seen], words.length[seen]
    found, blank = [crc], shift_table(1)[None]
    for k in range(1, longest):
        run = _shifted(blank, np.zeros(len(found[-1][:-1]), np.int64), found[-1][:-1]) ^ np.uint32(_BLANK)
        found.append(_shifted(words.tables, length[k:], run) ^ crc[k:])
    return found


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a translated text of about ``PIECE`` bytes, cut at blanks, with a blank at both ends."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield b" " + text[at:end] + b" "
        at = end


def _buckets_of(texts: list[bytes], buckets: int, longest: int) -> list[tuple[int, np.ndarray]]:
    """Of each text: the number of its words, and the bucket of each feature."""
    seen, counts, words = [], [], Dictionary(set().union(*(t.split() for t in texts)))
    for text in texts:
        parts = [words.scan(piece) for piece in _pieces(text)]
        seen += parts
        counts.append(sum(map(len, parts)))
    runs = compose(words, np.concatenate([*seen, np.zeros(0, np.int64)]), longest)
    runs = [(run % np.uint32(buckets)).astype(_kind(buckets)) for run in runs]
    ends = np.cumsum(counts)
    # Runs that reach into the next text are left out.
    return [(n, np.concatenate([run[b - n:max(b - n, b - k)] for k, run in enumerate(runs)])) for n, b in zip(counts, ends)]


def _scan(buckets: int, longest: int):
    def made(rows: list[tuple], schema: pa.Schema, out: list) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema) - 2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in out], pa.int64()), pa.array([x.tobytes() for _, x in out], pa.binary())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(f for f in batch.schema if f.name != "text"), ("n_words", pa.int64()), ("features", pa.binary())])
            ids = list(zip(*(batch.column(f.name).to_pylist() for f in batch.schema if f.name != "text")))
            rows, texts, size = [], [], 0
            for row, text in zip(ids, batch.column("text").cast(pa.binary())):
                text = (text.as_py() or b"").translate(_WORDS)
                if texts and size + len(text) > PIECE:
                    yield made(rows, schema, _buckets_of(texts, buckets, longest))
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(text)
                size += len(text)
            if texts:
                yield made(rows, schema, _buckets_of(texts, buckets, longest))

    return work


def features(texts: DataFrame, key: str, buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``key, n_words, features``: the buckets of all runs of 1 to ``longest`` words, two bytes each (four beyond 65 536 buckets)."""
    rows = texts.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_scan(buckets, longest), f"{key} long, n_words long, features binary"), "features")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: how many features of all rows fall into each bucket that has one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column("features"):
                total += np.bincount(np.frombuffer(cell.as_buffer(), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return found.select("features").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain``, a row for each bucket: 1000 times the log of the smoothed shares' ratio, rounded down."""
    s, t = raw.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    rows = written(raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s.hint("merge"), "bucket", "left").join(t.hint("merge"), "bucket", "left").fillna(0, ["s", "t"]), "counts")
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t").cast("double") + 1) * F.lit(float(all_s + buckets)) / ((F.col("s").cast("double") + 1) * F.lit(float(all_t + buckets)))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(gains: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c.as_buffer(), _kind(len(gains))) for c in batch.column("features")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(list(map(len, cells)), pa.int64()), pa.array([int(gains[c].sum()) for c in cells], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"])

    return work


def resample(
    docs: DataFrame, target: DataFrame, share_percent: int = 5, min_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, key: str = "item_id",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words``: a draw of ``docs`` that resembles ``target``.

    A document's weight is the sum of its features' gains, its score the weight
    plus Gumbel noise from a hash of ``seed`` and the id, so the largest scores
    are a draw without replacement by importance. Of the N rows with at least
    ``min_words`` words, the ``share_percent`` of N with the largest scores are
    drawn (rounded down; ties to the smaller ``doc_id``) and have a rank.

    Null and empty texts have no features and weight 0. A null id hashes as an
    empty one and comes after all others in ties; repeated rows count and are
    drawn each. Texts of any length are read whole. An empty target leaves all
    gains to the documents' own counts; no documents give no rows. Other
    columns, of any name, are ignored. The gains, one number a bucket, pass
    through the driver: ``buckets`` bounds them.
    """
    found = features(docs, "doc_id", buckets, longest)
    wanted = features(target, key, buckets, longest)
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets).collect():
        gains[row["bucket"]] = row["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = found.mapInArrow(_weights(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = written(scored.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")

    # All rows in the order of the draw, those that cannot be drawn last. An id holds the range and the place in it; ranges before it give the rest.
    order = [F.col("n_words") < min_words, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = written(ranges.select("*", F.shiftright("at", 33).alias("part"), (F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place")), "ranges")
    sizes = written(ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n_words") >= min_words, 1)).alias("able")), "sizes")
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = (sizes.agg(F.sum("able")).first()[0] or 0) * share_percent // 100
    ranked = ranges.join(F.broadcast(before), "part")  # a row for each range
    place = F.col("before") + F.col("place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).cast("long").alias("rank"), "n_words")
