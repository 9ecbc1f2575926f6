"""Removal of repeated byte strings by deep-shallow suffix sorting.

Two lengths are judged by one sort: strings of ``length`` bytes are removed
where they repeat, and shorter ones of ``passage`` bytes show the passages
that a document shares with another one. Every string of ``passage`` bytes
contains one anchor: the k-gram of smallest hash among those that lie in it,
the leftmost of equals. Equal strings have equal anchors at equal offsets, so
only suffixes of one anchor need sorting against each other. A record is an
anchor with the run of string starts that it serves, about one record for 65
bytes.

Records whose anchor occurs once go. Of the rest, records with equal regions
(all bytes that their strings of ``length`` bytes cover, or up to the text's
end) form a class; a class of two or more is repeated as a whole. The classes
of an anchor are then compared by sorting their suffixes from the anchor on,
and their texts from the anchor backwards: multikey quicksort over eight-byte
digits to a shallow depth, then blind tries order the groups that still agree.
Two classes share the string of n bytes that starts d before the anchor if
the text before it agrees for d bytes and the suffix for n - d, and in sorted
order both are read off the common prefixes of neighbours. An anchor with too
many classes for one task is refined: the starts are halved, each half is
keyed by the longer core that all its strings share, equal parts of classes
form new classes, and the steps repeat; when a half is a single start, its key
is the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: Bytes of an anchor; starts of a text handled at a time; classes of an anchor that a task sorts; classes sorted at once; shallow depth in digits.
GRAM, PIECE, GROUP_MAX, AT_ONCE, SHALLOW = 128, 1 << 18, 2048, 512, 4
#: What holds for a start: its string of ``length`` bytes is repeated; its string of ``passage`` bytes is in another document.
LONG, SHARED = 1, 2
_BASE = 0x9E3779B97F4A7C15
#: A number for each byte, so that hashes of texts in a few letters mix well.
_BYTES = np.random.default_rng(0).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _stirred(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Anchors:
    """Finds the records of texts: anchor, first and last start, size of the region, and hashes of anchor and region.

    Texts come as segments ``(bytes, starts)`` of which the first ``starts``
    places begin a string; many short ones are handled at once.
    """

    def __init__(self, length: int, passage: int) -> None:
        self.length, self.passage, self.gram = length, passage, min(GRAM, passage)
        self.width = passage - self.gram + 1
        n = 2 * PIECE + 2 * length
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def segments(self, data: bytes) -> Iterator[tuple[int, bytes, int]]:
        """``(place, bytes, starts)`` of a text; a segment holds all bytes of its strings."""
        starts = len(data) - self.passage + 1
        for at in range(0, max(starts, 0), PIECE):
            yield at, data[at : at + PIECE + self.length - 1], min(PIECE, starts - at)

    def _smallest(self, h: np.ndarray) -> np.ndarray:
        """For every start the place of the smallest hash among ``width``, the leftmost of equals."""
        order = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        w = self.width
        padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = order
        blocks = padded.reshape(-1, w)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        return (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def __call__(self, segments: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for x, _ in segments], np.int64)
        counts = np.array([n for _, n in segments], np.int64)
        begin = np.cumsum(sizes) - sizes
        b = _BYTES[np.frombuffer(b"".join(x for x, _ in segments), np.uint8)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * self.up[: len(b)], dtype=np.uint64)))
        h = _stirred((sums[self.gram :] - sums[: -self.gram]) * self.down[: len(b) - self.gram + 1])
        best = self._smallest(h)
        starts = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(segments)), counts)
        best = best[starts]  # strings that reach into the next segment are no starts
        cut = np.nonzero(best[1:] != best[:-1])[0] + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(best) - 1]))
        anchor, owner, first, last = best[first], owner[first], starts[first], starts[last]
        end = np.minimum(last + self.length, (begin + sizes)[owner])
        region = _stirred((sums[end] - sums[first]) * self.down[first])
        for x in (anchor - first, anchor - last, end - first):
            region = _stirred(region ^ x.view(np.uint64))
        gram = h[anchor]
        at = begin[owner]
        return owner, anchor - at, first - at, last - at, end - first, gram.view(np.int64), _stirred(region ^ gram).view(np.int64)


def _records(length: int, passage: int):
    names = ["gram", "cls", "doc_id", "text_key", "anchor", "low", "high", "size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, passage)

        def out(held: list) -> pa.RecordBatch:
            owner, anchor, first, last, size, gram, cls = find([x[3:] for x in held])
            place = np.array([x[2] for x in held], np.int64)[owner]
            columns = [gram, cls, pa.array([x[0] for x in held], pa.int64()).take(pa.array(owner)), pa.array([x[1] for x in held], pa.int64()).take(pa.array(owner)), anchor + place]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x.astype(np.int32)) for x in (anchor - last, anchor - first, size))], names)

        for batch in batches:
            held, total = [], 0
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary())):
                for place, data, starts in find.segments(text.as_py() or b""):
                    held.append((doc, key, place, data, starts))
                    total += len(data)
                    if total >= PIECE:
                        yield out(held)
                        held, total = [], 0
            if held:
                yield out(held)

    return work


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the regions that are asked for."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()):
            data = text.as_py()
            for w in wanted:
                first = w["anchor"] - w["high"]
                rows.append((w["gram"].to_bytes(8, "big", signed=True), w["cls"], data[first : first + w["size"]], w["low"], w["high"], w["doc_low"], w["doc_high"]))
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES)], _PART_NAMES)


_PART_NAMES = ["key", "cls", "bytes", "low", "high", "doc_low", "doc_high"]
_PART_TYPES = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
RECORDS = "gram long, cls long, doc_id long, text_key long, anchor long, low int, high int, size int"
PARTS = "key binary, cls long, bytes binary, low int, high int, doc_low long, doc_high long"
RANGES = "cls long, low int, high int, mask int"


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Groups of equal strings (all of one length), in sorted order; a trie that stores branching places only."""
    groups: list[list[int]] = [[0]]
    root: list | int = 0  # a leaf is its group's number, a branch [place, {byte: child}]
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while not isinstance(node, int):  # blind descent: only branching bytes are compared
            place, children = node
            node = children.get(s[place])
            if node is None:
                node = next(iter(children.values()))
        other = strings[groups[node][0]]
        if s == other:
            groups[node].append(k)
            continue
        low, high = 0, len(s)  # the first place where the two differ
        while high - low > 1:
            mid = (low + high) // 2
            if s[low:mid] == other[low:mid]:
                low = mid
            else:
                high = mid
        groups.append([k])
        leaf, parent, node = len(groups) - 1, None, root
        while not isinstance(node, int) and node[0] < low:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == low:
            node[1][s[low]] = leaf
            continue
        branch = [low, {other[low]: node, s[low]: leaf}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            order.append(groups[node])
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return order


def sorted_suffixes(key: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(order, common)``: strings by key, then content, and for each place the bytes it shares with the place before.

    ``key`` is ascending; -1 marks the first place of a key. Shorter strings
    count as filled up with zero bytes.
    """
    wide = max(8 * SHALLOW, -(-max(map(len, strings)) // 8) * 8)
    table = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in strings), np.uint8).reshape(len(strings), wide)
    digits = table[:, : 8 * SHALLOW].copy().view(">u8").astype(np.uint64)
    order = np.lexsort((*digits.T[::-1], key))
    same = (key[order[1:]] == key[order[:-1]]) & (digits[order[1:]] == digits[order[:-1]]).all(axis=1)
    cuts = np.nonzero(np.concatenate(([True], ~same, [True])))[0]
    for a, z in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()):
        group = order[a:z]
        order[a:z] = group[[i for equal in blind_trie([table[k].tobytes() for k in group.tolist()]) for i in equal]]
    differ = table[order[1:]] != table[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common[key[order[1:]] != key[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def repeated_ranges(key: np.ndarray, parts: list[tuple[bytes, int, int, int, int]], length: int, passage: int) -> list[tuple[int, int, int, int]]:
    """``(part, low, high, mark)``: offsets of the parts ``(region, low, high, doc_low, doc_high)`` whose strings a part of the same key has too.

    The string at offset d starts d bytes before the anchor, the region at
    offset high; ``key`` is ascending. ``LONG``: another part has the string of
    ``length`` bytes. ``SHARED``: the parts that have the string of ``passage``
    bytes are of two documents and more.
    """
    m = len(parts)
    low, high, doc_low, doc_high = (np.array([p[k] for p in parts], np.int64) for k in (1, 2, 3, 4))
    right = np.array([len(p[0]) for p in parts]) - high
    width = int(high.max()) + 1
    place, blocks, reach = [], [], []
    for strings in ([p[0][p[2] :] for p in parts], [p[0][: p[2]][::-1] for p in parts]):
        order, common = sorted_suffixes(key, strings)
        at = np.empty(m, np.int64)
        at[order] = np.arange(m)
        place.append(at)
        blocks.append(common)
        reach.append(np.maximum(common, np.append(common[1:], -1))[at])  # bytes shared with the nearest other string
    offsets = np.arange(width)
    before = np.cumsum(blocks[1][None, :] < offsets[:, None], axis=1, dtype=np.int32)  # of each offset and place the block of strings that agree before the anchor
    found = []
    for n, mark in ((length, LONG), (passage, SHARED)):
        first, last = np.maximum(low, n - np.minimum(reach[0], right)), np.minimum(high, reach[1])
        counts = np.maximum(last - first + 1, 0)
        own = np.repeat(np.arange(m), counts)
        if not len(own):
            continue
        d = np.arange(len(own)) + np.repeat(first - np.cumsum(counts) + counts, counts)
        after = np.cumsum(blocks[0][None, :] < (n - offsets)[:, None], axis=1, dtype=np.int32)
        code = (d * (m + 1) + before[d, place[1][own]]) * (m + 1) + after[d, place[0][own]]
        order = np.argsort(code, kind="stable")
        cuts = np.nonzero(np.concatenate(([True], code[order[1:]] != code[order[:-1]])))[0]
        held = own[order]
        if mark == LONG:
            marked = np.diff(np.append(cuts, len(order))) > 1
        else:
            marked = np.minimum.reduceat(doc_low[held], cuts) < np.maximum.reduceat(doc_high[held], cuts)
            # a class of several documents is marked as a whole
            marked &= np.diff(np.append(cuts, len(order))) > 1
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(marked, np.diff(np.append(cuts, len(order))))
        own, d = own[hit], d[hit]  # by part, then offset
        if len(own):
            new = np.nonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (d[1:] != d[:-1] + 1))))[0]
            end = np.append(new[1:], len(own)) - 1
            found += zip(own[new].tolist(), d[new].tolist(), d[end].tolist(), [mark] * len(new))
    return found


def _sorted_groups(length: int, passage: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls: list[int] = []
        keys: list[int] = []
        parts: list[tuple] = []
        last, number = None, 0

        def out() -> pa.RecordBatch:
            rows = repeated_ranges(np.array(keys, np.int64), parts, length, passage) if parts else []
            columns = list(zip(*((cls[k], *rest) for k, *rest in rows))) or [[]] * 4
            cls.clear(), keys.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["cls", "low", "high", "mask"])

        for batch in batches:
            for key, own, *part in zip(*(batch.column(c).to_pylist() for c in _PART_NAMES)):
                if key != last:
                    if len(parts) >= AT_ONCE:
                        yield out()
                    last, number = key, number + 1
                cls.append(own)
                keys.append(number)
                parts.append(part)
        yield out()

    return work


def _refined(length: int, passage: int, width: int, size: int):
    """Cut parts to blocks of ``size`` offsets; a block's key is the core that all strings of its offsets share."""
    names = ["key", "sub", *_PART_NAMES[1:]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, data, low, high, *docs in zip(*(batch.column(c).to_pylist() for c in _PART_NAMES[1:])):
                for block in range(low // size, high // size + 1):
                    least, most = block * size, min(block * size + size, width) - 1
                    core = data[high - least : high - most + passage]
                    a, z = max(low, least), min(high, most)
                    own = data[high - z : high - a + length]
                    rows.append((xxhash.xxh3_128_digest(b"%d," % block + core), xxhash.xxh64_intdigest(b"%d,%d," % (a, z) + own) - (1 << 63), cls, own, a, z, *docs))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int64(), *_PART_TYPES[1:]])], names)

    return work


def _whole(classes: DataFrame, length: int) -> DataFrame:
    """Ranges of the classes of two members and more: all their strings are repeated."""
    least = F.greatest(F.col("low"), F.lit(length) - F.col("size") + F.col("high"))  # offsets below it reach beyond the text
    shared = F.when(F.col("doc_low") < F.col("doc_high"), F.lit(SHARED)).otherwise(0)
    pieces = F.array(F.struct("low", F.least(F.col("high"), least - 1).alias("high"), shared.alias("mask")), F.struct(least.alias("low"), "high", (shared + LONG).alias("mask")))
    return classes.where("n > 1").select("cls", F.explode(F.filter(pieces, lambda x: (x["low"] <= x["high"]) & (x["mask"] > 0))).alias("x")).select("cls", "x.low", "x.high", "x.mask")


def _runs(ranges: DataFrame) -> DataFrame:
    """``cls, low, high, mask`` with ranges of a class and mark that overlap or touch as one; a class has at most one for two offsets and mark."""
    marks = F.filter(F.array(F.lit(LONG), F.lit(SHARED)), lambda m: F.col("mask").bitwiseAND(m) > 0)
    rows = ranges.select("cls", "low", "high", F.explode(marks).alias("mask")).groupBy("cls", "mask").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("x"))
    ends = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def add(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(ends(last["low"], F.greatest(last["high"], x["high"]))))
        return F.when((F.size(runs) > 0) & (last["high"] >= x["low"] - 1), longer).otherwise(F.concat(runs, F.array(ends(x["low"], x["high"]))))

    rows = rows.select("cls", "mask", F.explode(F.aggregate("x", F.array().cast("array<struct<low:int,high:int>>"), add)).alias("x"))
    return rows.select("cls", "x.low", "x.high", "mask")


def _compared(parts: DataFrame, length: int, passage: int, width: int, size: int) -> DataFrame:
    """``cls, low, high, mask``: marked offsets of the classes that share their key with another class.

    ``parts`` has a row for each class; keys of many classes are refined.
    """
    groups = written(parts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("doc_low").alias("a"), F.max("doc_high").alias("z")), "groups")
    small = parts.join(groups.where(F.col("m").between(2, GROUP_MAX)).select("key").hint("merge"), "key").select(*_PART_NAMES)
    found = written(small.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length, passage), RANGES), "sorted")
    large = groups.where(F.col("m") > GROUP_MAX)
    if large.isEmpty():
        return found
    if size == 1:  # the key is the string of ``passage`` bytes itself; equal ones of ``length`` bytes are one class
        shared = parts.join(large.where("a < z").select("key").hint("merge"), "key").select("cls", "low", "high", F.lit(SHARED).alias("mask"))
        return found.unionByName(written(shared, "shared"))
    size = (size + 1) // 2
    hot = parts.join(large.select("key").hint("merge"), "key").select(*_PART_NAMES)
    finer = written(hot.mapInArrow(_refined(length, passage, width, size), PARTS.replace("cls", "sub long, cls")), "finer")
    members = finer.withColumn("fine", F.xxhash64("key", "sub"))
    classes = members.groupBy("key", F.col("fine").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("bytes", "low", "high")).alias("r"), F.min("doc_low").alias("doc_low"), F.max("doc_high").alias("doc_high"))
    classes = written(classes.select("cls", "n", "key", "r.*", F.length("r.bytes").alias("size"), "doc_low", "doc_high"), "fine")
    # single offsets of the deeper levels become runs before they meet the members, so a member has a few rows whatever the depth
    deeper = _runs(_whole(classes, length).unionByName(_compared(classes.select(*_PART_NAMES), length, passage, width, size)))
    back = members.select(F.col("fine"), F.col("cls").alias("of"))
    back = deeper.join(back.hint("merge"), deeper.cls == back.fine).select(F.col("of").alias("cls"), "low", "high", "mask")
    return found.unionByName(written(back, "back"))


def _merged(row: np.ndarray, a: np.ndarray, z: np.ndarray, rows: int) -> list[list[tuple[int, int]]]:
    """Of each row the maximal runs that its ranges ``a`` to ``z`` cover."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    if len(a):
        far = int(z.max()) + 1
        order = np.lexsort((a, row))
        row, a, z = row[order], a[order] + row[order] * far, z[order] + row[order] * far
        reach = np.maximum.accumulate(z)
        new = np.nonzero(np.concatenate(([True], a[1:] > reach[:-1])))[0]
        ends = reach[np.append(new[1:], len(a)) - 1]
        for r, x, y in zip(row[new].tolist(), (a[new] - row[new] * far).tolist(), (ends - row[new] * far).tolist()):
            out[r].append((x, y))
    return out


def _removed(length: int, passage: int, passage_words: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column("cuts")
            n = len(batch)
            row = np.repeat(np.arange(n), cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            first, last, mask = (x.to_numpy(zero_copy_only=False) for x in cuts.flatten().flatten())
            long, shared = mask & LONG > 0, mask & SHARED > 0
            removed = _merged(row[long], first[long], last[long] + length, n)
            passages = _merged(row[shared], first[shared], last[shared] + passage, n)
            sizes, gone, runs, sums, counts, texts = [], [], [], [], [], []
            for text, out_of, with_others in zip(batch.column("text").cast(pa.binary()), removed, passages):
                data = text.as_py() or b""
                left = b"".join([data[a:z] for a, z in zip([0, *(z for _, z in out_of)], [*(a for a, _ in out_of), len(data)])]) if out_of else data
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                runs.append(len(out_of))
                sums.append(hashlib.sha256(left).hexdigest())
                counts.append(sum(len(data[a:z].split(None, passage_words)) > passage_words for a, z in with_others))
                texts.append(left)
            out = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, gone, runs)), pa.array(sums, pa.string()), pa.array(counts, pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"]
            if with_text:
                out.append(pa.array(texts, pa.binary()))
                names.append("kept_bytes")
            yield pa.RecordBatch.from_arrays(out, names)

    return work


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 256, passage_words: int = 50, with_text: bool = False) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers, and count the passages shared with other documents.

    A string is repeated if it starts at another place too, in the same text
    or in another; strings are judged on the input. ``n_passages`` counts the
    maximal runs of bytes that strings of ``passage`` bytes (``length`` at
    most) cover which another document has too, if the run has over
    ``passage_words`` words, cut ones included; nothing is removed for them.
    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages``
    and, on demand, ``kept_bytes``; a row for each row of ``docs``. Other
    columns of ``docs``, of any name, are ignored.

    A null text counts as empty. Repeated rows are different places, so long
    ones lose all their bytes; for ``n_passages`` they are one document. Null
    and equal ids are told apart by the text's hash. Texts shorter than
    ``length`` stay. Texts of any length are read whole, a piece at a time. A
    removal may split a character, so what is left is bytes. No rows give no rows.
    """
    passage = min(passage, length)
    width = Anchors(length, passage).width
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_key"))
    long = rows.where(F.octet_length("text") >= passage)
    records = written(long.mapInArrow(_records(length, passage), RECORDS), "records")
    twice = written(records.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "twice")
    kept = written(records.join(twice.hint("shuffle_hash"), "gram", "left_semi"), "kept")
    doc = F.xxhash64("doc_id", "text_key")
    classes = kept.groupBy("gram", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "anchor", "low", "high", "size")).alias("r"), F.min(doc).alias("doc_low"), F.max(doc).alias("doc_high"))
    classes = written(classes.select("gram", "cls", "n", "r.*", "doc_low", "doc_high"), "classes")
    several = written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"), "several")
    wanted = classes.join(several.hint("shuffle_hash"), "gram", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.collect_list(F.struct("gram", "cls", "anchor", "low", "high", "size", "doc_low", "doc_high")).alias("wanted"))
    sources = long.join(wanted.hint("merge"), long.doc_id.eqNullSafe(F.col("d")) & (long.text_key == F.col("k"))).select("doc_id", "text", "wanted")
    # repeated rows would give their classes twice
    parts = written(sources.mapInArrow(_regions, PARTS), "parts").dropDuplicates(["cls"])
    ranges = _runs(_whole(classes, length).unionByName(_compared(parts, length, passage, width, width)))
    cuts = kept.join(ranges.hint("merge").withColumnsRenamed({"low": "from", "high": "to"}), "cls").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.collect_set(F.struct((F.col("anchor") - F.col("to")).alias("a"), (F.col("anchor") - F.col("from")).alias("z"), "mask")).alias("cuts"))
    joined = rows.join(cuts.hint("merge"), rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("k")), "left").select("doc_id", "text", "cuts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept_bytes binary" * with_text
    return joined.mapInArrow(_removed(length, passage, passage_words, with_text), schema)
