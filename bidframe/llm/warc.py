"""WARC archives with a two-level capture index.

Archives: each task writes its pages as records, a gzip member each, into
files of its own in the shared folder, and returns a capture (key, file,
offset, length) for each. Only the captures of tasks that succeeded are kept,
so the files of a lost attempt are never read.

Index: captures are sorted by reversed-host URL key and cut into compressed
blocks, gzip members of one file for each range of keys. A sparse directory
for each range has the first key and the place of its blocks; a table of the
ranges has the first key of each. A lookup finds the range, then the block,
then the line by binary search, and reads the block's bytes and the record's
bytes by their offsets; it holds one directory and one block at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidframe.llm._common import shared_folder, written

#: Captures of a block, and bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 1_000, 256 << 20
#: Most repeated payloads that are broadcast (36 bytes each); beyond, the pages are joined by sort and merge.
BROADCAST_ROWS = 500_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
_LINE = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "file", "offset", "length")
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_url string, payload string"


def _one_line(url: str) -> str:
    """A header value: line breaks would end it."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: the host reversed and lower-cased, without scheme, user, default port and fragment. Null gives an empty key."""
    if not url:
        return ""
    url = _one_line(url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    name = host if ":" in host or host.replace(".", "").isdigit() else ",".join(reversed(host.split(".")))
    tail = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()) else ""
    return f"{name}{tail}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class _Appender:
    """A file of gzip members under a name that no other attempt uses."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.fs, path = _filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name, self.size = f"{uuid.uuid4().hex}{suffix}", 0
        self.stream = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        """Append one member; where it lies and how long it is."""
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        at = self.size
        self.stream.write(member)
        self.size += len(member)
        return at, len(member)

    def close(self) -> None:
        self.stream.close()


class _Reader:
    """Range reads of gzip members; one file is open at a time."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = _filesystem(folder)
        self.name, self.file = None, None

    def bytes(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)

    def member(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.bytes(name, offset, length), 31)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest.lower()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, is_revisit: bool, date: str) -> bytes:
    """One WARC 1.1 record with its HTTP header; a revisit's block has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        if refers_to_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(refers_to_url)}")
    block = http if is_revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields and the payload (None for a revisit) of one record; raises if the payload is not the one that the digest names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(name: str) -> int | None:
        number = fields[name].split(":")[2] if name in fields else ""
        return int(number) if number else None

    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record of page {page('WARC-Record-ID')}")
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page("WARC-Refers-To"), "refers_to_url": fields.get("WARC-Refers-To-Target-URI"), "payload": payload if kind == "response" else None}


@dataclass(frozen=True)
class CaptureIndex:
    """A folder of archives, blocks and directories, and the table of its key ranges."""

    folder: str
    ranges: DataFrame


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` with the page that a payload is stored under, where several share it."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # Only digests and ids are shuffled; the kept page is the largest id of a payload.
    keys = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("keeper"))
    shared = written(keys.where("n > 1").select("digest", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("keeper_url")), "shared")
    shared = shared.hint("broadcast" if shared.count() <= BROADCAST_ROWS else "merge")
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", F.hex("digest").alias("digest"), "keeper", "keeper_url")


def _write(folder: str, date: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page_id, url, payload, hexadecimal, keeper, keeper_url in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "keeper", "keeper_url"))):
                page_id, url, payload, digest = page_id.as_py(), url.as_py(), payload.as_py(), _base32(hexadecimal.as_py())
                keeper, keeper_url = keeper.as_py(), keeper_url.as_py()
                again = keeper is not None and page_id != keeper
                out = out or _Appender(folder, ".warc.gz")
                at, size = out.add(record(page_id, url, payload, digest, keeper if again else None, keeper_url, again, date))
                rows.append((url_key(url), page_id, url, "revisit" if again else "response", digest, len(payload), keeper if again else None, out.name, at, size))
                if out.size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield _batch(rows, CAPTURE)
        if out is not None:
            out.close()

    return work


_ARROW = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as WARC records; returns the captures.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those of the
    largest id are responses, the others revisits of it. Rows that repeat the
    largest id are responses all; a null id is the smallest, and pages that
    share a payload under null ids alone are responses. A null html is an empty
    payload, a null url has an empty key. Payloads of any length are whole
    records. Other columns, of any name, are ignored; no rows give no captures.
    """
    return written(_roles(pages, min_bytes).mapInArrow(_write(folder, date), CAPTURE), "captures")


def _sort_key(urlkey: str, page_id: int | None) -> tuple[str, int]:
    """Keys compare as strings of code points, which is the order of their UTF-8 bytes."""
    return urlkey, -(1 << 63) if page_id is None else page_id


def _index(folder: str, lines: int):
    schema = "first_key string, first_page long, last_key string, last_page long, blocks long, captures long, directory string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, directory, last, count = None, [], [], None, 0

        def flush() -> None:
            at, size = out.add("\n".join(line for _, _, line in block).encode())
            directory.append([block[0][0], block[0][1], out.name, at, size])
            block.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("urlkey", *_LINE)]
            for key, page, *rest in zip(*columns):
                out = out or _Appender(folder, ".cdx.gz")
                block.append((key, page, json.dumps([key, page, *rest], ensure_ascii=False)))
                last, count = (key, page), count + 1
                if len(block) >= lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        sparse = _Appender(folder, ".directory.gz")
        _, size = sparse.add(json.dumps(directory, ensure_ascii=False).encode())
        sparse.close()
        yield _batch([(*directory[0][:2], *last, len(directory), count, f"{sparse.name}:{size}")], schema)

    return work, schema


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures by key and page, write blocks and directories; ranges of keys are dealt to tasks, so a hot host is spread by path and page."""
    spark = captures.sparkSession
    order = ["urlkey", F.asc_nulls_first("page_id"), "file", "offset"]
    work, schema = _index(folder, block_lines)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = written(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, schema), "ranges")
    return CaptureIndex(folder, ranges)


def _matches(reader: _Reader, tops: list[tuple], firsts: list[tuple]):
    """A function from (key, page or None for any) to the captures under it; it keeps the last directory and block."""
    held: dict = {"directory": (None, [], []), "block": (None, [])}

    def directory(k: int) -> tuple[list, list]:
        if held["directory"][0] != k:
            name, _, size = tops[k].rpartition(":")
            entries = json.loads(reader.member(name, 0, int(size)))
            held["directory"] = k, entries, [_sort_key(e[0], e[1]) for e in entries]
        return held["directory"][1:]

    def block(entry: list) -> list[list]:
        place = tuple(entry[2:])
        if held["block"][0] != place:
            held["block"] = place, [json.loads(x) for x in reader.member(*place).decode().split("\n")]
        return held["block"][1]

    def find(key: str, low: int, high: int) -> Iterator[list]:
        start, stop = (key, low), (key, high)
        k = max(0, bisect.bisect_left(firsts, start) - 1)
        while k < len(firsts) and firsts[k] <= stop:
            entries, keys = directory(k)
            b = max(0, bisect.bisect_left(keys, start) - 1)
            while b < len(keys) and keys[b] <= stop:
                lines = block(entries[b])
                at = bisect.bisect_left(lines, start, key=lambda x: _sort_key(x[0], x[1]))
                while at < len(lines) and _sort_key(lines[at][0], lines[at][1]) <= stop:
                    yield lines[at]
                    at += 1
                b += 1
            k += 1

    return find


def lookup(index: CaptureIndex, wanted: DataFrame, by_page: bool = False) -> DataFrame:
    """The captures of ``wanted.url``; with ``by_page`` only those of ``wanted.page_id`` too.

    Repeated questions are asked once, so each capture comes once, however
    often it is asked for. Questions are dealt and sorted by key, so a block is
    read about once a task. The table of ranges, a row for each range that the
    index was written in, goes to all tasks. A null url asks for captures
    without one; unknown urls give nothing.
    """
    spark: SparkSession = wanted.sparkSession
    columns = ["url", "page_id"] if by_page else ["url"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("page_id") if by_page else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column("url").to_pylist()), pa.string()), pages], ["urlkey", "page_id"])

    ranges = sorted((_sort_key(r["first_key"], r["first_page"]), r["directory"]) for r in index.ranges.collect())
    firsts, tops = [r[0] for r in ranges], [r[1] for r in ranges]
    folder = index.folder

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        find = _matches(reader, tops, firsts)
        for batch in batches:
            rows = []
            for key, page in zip(batch.column("urlkey").to_pylist(), batch.column("page_id").to_pylist()):
                _, low = _sort_key(key, page)
                rows += (tuple(x) for x in find(key, low, low if by_page else 1 << 63))
                if len(rows) >= 10_000:
                    yield _batch(rows, CAPTURE)
                    rows = []
            yield _batch(rows, CAPTURE)
        reader.close()

    asked = wanted.select(*columns).distinct().mapInArrow(keys, "urlkey string, page_id long").distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = written(asked, "asked")
    return asked.repartitionByRange(parts, "urlkey", F.asc_nulls_first("page_id")).sortWithinPartitions("urlkey", F.asc_nulls_first("page_id")).mapInArrow(work, CAPTURE)


def read_records(index: CaptureIndex, captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_url, payload``: the records at the captures' places, each read by its range and checked against its digest.

    A payload is null unless asked for, and in a revisit; see ``resolved``.
    """
    folder, names = index.folder, [f.split()[0] for f in _RECORD.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            rows, size = [], 0
            places = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for place in places:
                found = parse_record(reader.member(*place))
                found["payload"] = found["payload"].decode() if with_payload and found["payload"] is not None else None
                size += len(found["payload"] or "")
                rows.append(tuple(found[n] for n in names))
                if size >= 32 << 20:
                    yield _batch(rows, _RECORD)
                    rows, size = [], 0
            yield _batch(rows, _RECORD)
        reader.close()

    return captures.select("file", "offset", "length").mapInArrow(work, _RECORD)


def resolved(index: CaptureIndex, records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits, looked up under the page that they refer to. Each response is read once, however many revisit it."""
    revisits = records.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to_url").alias("url"), F.col("refers_to").alias("page_id")).distinct()
    found = read_records(index, lookup(index, wanted, by_page=True), with_payload=True)
    found = written(found.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload")).dropDuplicates(["_page", "_digest"]), "responses")
    same = (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    again = revisits.join(found.hint("merge"), same, "left").withColumn("payload", F.col("_payload")).drop("_page", "_digest", "_payload")
    return records.where("record_type <> 'revisit'").unionByName(again)


def archive_pages(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES, folder: str | None = None) -> CaptureIndex:
    """Archives and index of ``pages``, in a new shared folder unless one is named; edge cases as in ``write_archives``."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc"
    return build_index(write_archives(pages, folder, min_bytes), folder, block_lines)


def replay(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from its record.

    Pages are archived and indexed; each page's url and id are then looked up
    in the index, and its record is read from the archive. Repeated rows give a
    row each; see ``write_archives`` for nulls.
    """
    index = archive_pages(pages, min_bytes)
    asked = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(index, lookup(index, asked, by_page=True)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
