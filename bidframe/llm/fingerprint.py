"""Context-triggered piecewise hashing.

A rolling hash over seven bytes sets the boundaries of chunks; a chunk's hash
gives one sign of a signature. The block size doubles with the length, and a
fingerprint has the signatures of its own and of the doubled block size, so
that texts of unlike length still compare. Likeness is an edit distance of
signatures at a block size that both have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.llm._common import written

WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Rows of a cell of neighbouring ids on average; most cells, which bounds the broadcast table of their first rows.
CELL, MOST_CELLS = 5_000, 10_000
_PIECE = 1 << 20


def rolling(data: bytes) -> np.ndarray:
    """The rolling hash at every byte: sum, weighted sum and shifted xor of the last seven bytes."""
    out = np.empty(len(data), np.uint32)
    for at in range(0, len(data), _PIECE):
        head = data[max(0, at - WINDOW + 1) : at]
        b = np.frombuffer(bytes(WINDOW - 1 - len(head)) + head + data[at : at + _PIECE], np.uint8).astype(np.uint32)
        n = len(b) - WINDOW + 1
        plain, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
        for j in range(WINDOW):
            x = b[WINDOW - 1 - j : WINDOW - 1 - j + n]
            plain += x
            weighted += x * np.uint32(WINDOW - j)
            shifted ^= x << np.uint32(5 * j % 32)
        out[at : at + n] = plain + weighted + shifted
    return out


def _signature(data: bytes, rolled: np.ndarray, block: int) -> str:
    ends = (np.nonzero(rolled % np.uint32(block) == block - 1)[0][: LENGTH - 1] + 1).tolist()
    starts = [0, *ends]
    if starts[-1] < len(data):
        ends.append(len(data))
    return "".join(SIGNS[xxhash.xxh64_intdigest(data[a:b]) & 63] for a, b in zip(starts, ends))


def fingerprint(data: bytes) -> str:
    """``block size:signature:signature at twice the block size``."""
    rolled = rolling(data)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        first = _signature(data, rolled, block)
        if len(first) >= LENGTH // 2 or block == LEAST_BLOCK:
            return f"{block}:{first}:{_signature(data, rolled, 2 * block)}"
        block //= 2


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table in the bits of two integers."""
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = masks.get(c, 0)
        cross = eq | down
        zero = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = (minus | ~(cross | plus)) & full, plus & cross
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    need = min(WINDOW, len(a), len(b))
    if not need or not {a[i : i + need] for i in range(len(a) - need + 1)} & {b[i : i + need] for i in range(len(b) - need + 1)}:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size or no run of seven signs is shared."""
    if x == y:
        return 1.0
    (p, x1, x2), (q, y1, y2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(x1, y1), _alike(x2, y2))
    if p == 2 * q:
        return _alike(x1, y2)
    if q == 2 * p:
        return _alike(x2, y1)
    return 0.0


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell and order; each row of lap 0 meets the row after it."""
    held = None
    for batch in batches:
        out = []
        for cell, lap, doc, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "lap", "doc_id", "text"))):
            if lap and held is None:
                continue
            text = text or ""
            print_ = fingerprint(text.encode())
            if held is not None:
                before, own, own_print = held
                cut = len(own) // 4
                edited = (own[: len(own) - cut] + text[:cut]).encode()
                edited_print = fingerprint(edited) if cut else own_print
                out.append((before, len(own), hashlib.sha256(edited).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, print_)))
            held = None if lap else (doc, text, print_)
        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in NAMES[2:5]), *((n, pa.float64()) for n in NAMES[5:])]))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness; a row for each row of ``docs``.

    The edit replaces the last quarter of the code points, rounded down, by as
    many first ones (or all) of the next document in ``doc_id`` order; the
    first follows the last. Null ids come first, equal ids are ordered by text,
    so repeated rows are neighbours. A null text counts as empty. A single row
    is its own next. Texts of any length are read whole; other columns of
    ``docs``, of any name, are ignored. No rows give no rows.

    Rows are dealt into cells of neighbouring ids; a copy of each cell's first
    row closes the cell before it, so texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ids = rows.select(F.col("doc_id").cast("double").alias("d"))
    n = ids.count()
    cells = max(1, min(MOST_CELLS, math.ceil(n / CELL)))
    cuts = sorted(set(ids.approxQuantile("d", [k / cells for k in range(1, cells)], 0.25 / cells))) if cells > 1 else []
    if cuts:
        splits = [-math.inf, *cuts, math.inf]
        rows = Bucketizer(splits=splits, inputCol="d", outputCol="b", handleInvalid="keep").transform(rows.withColumn("d", F.col("doc_id").cast("double")))
        rows = rows.withColumn("cell", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("b")).cast("int"))
    else:
        rows = rows.withColumn("cell", F.lit(0))
    firsts = rows.groupBy("cell").agg(F.when(F.max(F.col("doc_id").isNull()), F.lit(None).cast("long")).otherwise(F.min("doc_id")).alias("first_id"))
    everywhere = Window.orderBy("cell")
    last = F.max("cell").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = written(firsts.select(F.col("cell").alias("of_cell"), "first_id", F.coalesce(F.lag("cell").over(everywhere), last).alias("before")), "firsts")
    # at most MOST_CELLS rows: the broadcast is bounded
    rows = rows.join(F.broadcast(firsts), (F.col("cell") == F.col("of_cell")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    places = F.array(F.struct(F.col("cell").alias("cell"), F.lit(0).alias("lap")), F.when(F.col("of_cell").isNotNull(), F.struct(F.col("before").alias("cell"), F.lit(1).alias("lap"))))
    rows = rows.select("doc_id", "text", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("p")).select("p.cell", "p.lap", "doc_id", "text")
    ordered = rows.repartition("cell").sortWithinPartitions("cell", "lap", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(_neighbours, SCHEMA)
