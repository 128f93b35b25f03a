"""WARC archives: a writer of gzip members and a splittable reader.

The writer stores each record as a gzip member of its own, so a file can be read from the middle. The reader deals byte
ranges of the files to tasks. A task scans its range for the gzip magic, takes a place as a member only if it inflates to a
WARC header, and owns the records that start inside its range, reading past the range's end to finish the last one. Where a
range begins inside a member that itself holds gzipped records, the scan of the range before says where its own records begin.

Files live in the folder all executors share and are opened through `pyarrow.fs`, by URI. A task writes to a name of its own
attempt and renames it when complete, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.llm.common import hot_keys, map_arrow, scratch, stored

# The start of a gzip member with deflate, the record version, and the public revisit profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: WARC-Date of all records: the pages carry no time.
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "<urn:page:{}>"


def opened(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, sha: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; with `refers_to` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    one_line = lambda s: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": RECORD_ID.format("" if page_id is None else page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = one_line(url)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": RECORD_ID.format(refers_to)}
    head |= {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, sha1 and refers_to.

    Of records with equal payloads of at least `least_bytes` bytes the smallest page_id is the response; null html is empty. Rows
    that repeat the response's page_id are responses too, as is a row without page_id where no other has the payload. The first of
    each payload is found by a partial minimum. The payloads of frequent ones, known from their counts, are looked up in a small
    broadcast table and dropped before the shuffle, but for the response's; so no task gets a frequent payload's copies.
    """
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    raw = raw.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    first = stored(raw.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-first")
    hot = hot_keys(first, "sha1", "n")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "payload_bytes", "sha1", F.when(again, F.col("first")).alias("refers_to")]
    if not hot:
        return raw.join(first.select("sha1", "first"), "sha1", "left").select(*columns)
    known = raw.sparkSession.createDataFrame([(k,) for k in hot], "sha1 string").join(first, "sha1").select("sha1", "first")
    # Fewer rows than HOT_SHARE.
    frequent = raw.join(F.broadcast(known), "sha1").select(*columns)
    rest = raw.join(F.broadcast(known.select("sha1")), "sha1", "left_anti").join(first.select("sha1", "first"), "sha1", "left").select(*columns)
    # The frequent ones, now without payloads, go over all tasks that write.
    return rest.unionByName(frequent.repartition(F.xxhash64("page_id", "url")))


def write_warc(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives below `path` (default: a new folder in the shared folder).

    Returns the written files: path, bytes, records. The table of files is itself stored, so it is written once.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        out = files = None
        own, n, records = f"{name}.{uuid.uuid4().hex}.tmp", 0, 0
        for batch in batches:
            for page_id, url, payload, length, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files, inner = opened(own)
                    files.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(inner)
                sha32 = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record(page_id, url, payload, length, sha32, refers_to)
                out.write(member)
                n, records = n + len(member), records + 1
        if out is not None:
            out.close()
            files.move(inner, opened(name)[1])
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [n], "records": [records]})

    return stored(map_arrow(resolve_revisits(pages, least_bytes), write, "path string, bytes long, records long"), "warc-files")


class _Window:
    """A file read forward in blocks, of which only what is still needed is held."""

    def __init__(self, source, begin: int, block: int = 1 << 18):
        source.seek(begin)
        self.source, self.begin, self.data, self.block, self.ended = source, begin, bytearray(), block, False

    def more(self) -> bool:
        part = b"" if self.ended else self.source.read(self.block)
        self.ended = not part
        self.data += part
        return bool(part)

    def forget(self, upto: int) -> None:
        del self.data[: upto - self.begin]
        self.begin = upto


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member at a place, and where it ends; None if it isn't one or has no WARC header."""
    inflate, out, used = zlib.decompressobj(31), bytearray(), at
    while not inflate.eof:
        if used - window.begin >= len(window.data) and not window.more():
            return None
        part = bytes(window.data[used - window.begin :])
        try:
            out += inflate.decompress(part)
        except zlib.error:
            return None
        used += len(part) - len(inflate.unused_data)
        if len(out) >= len(VERSION) and not out.startswith(b"WARC/"):
            return None
    return (bytes(out), used) if out.startswith(b"WARC/") else None


def members_in_range(uri: str, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of the members that a scan from `begin` finds before `end` (None: the file's end), in order.

    After a member the scan goes on at its end, so what lies inside one isn't looked at; but `begin` itself may lie inside one.
    """
    files, path = opened(uri)
    with files.open_input_file(path) as source:
        end = source.size() if end is None else end
        window, at = _Window(source, begin), begin
        while at < end:
            found = window.data.find(MAGIC, at - window.begin)
            if found < 0:
                # Two bytes stay: a magic may lie across blocks.
                at = max(at, window.begin + len(window.data) - 2)
                window.forget(max(window.begin, at))
                if not window.more():
                    return
                continue
            at = window.begin + found
            if at >= end:
                return
            window.forget(at)
            whole = _member(window, at)
            if whole is None:
                at += 1
                continue
            yield at, whole[0]
            at = whole[1]


def next_start(uri: str, begin: int, end: int) -> int | None:
    """Where the scan from `begin` finds its first member at or after `end`; None at the file's end."""
    return next((at for at, _ in members_in_range(uri, begin, None) if at >= end), None)


def _length(said: str | None, otherwise: int) -> int:
    """A length as a header says it; where it says none that can be read, the other one."""
    return int(said) if said is not None and said.isascii() and said.isdigit() and len(said) < 19 else otherwise


def _fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records_in_range(uri: str, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (by lower-case name) and block of each record that a scan from `begin` finds before `end`."""
    for at, whole in members_in_range(uri, begin, end):
        head, _, block = whole.partition(b"\r\n\r\n")
        headers = _fields(head)
        yield at, headers, block[: _length(headers.get("content-length"), len(block))]


def owned_ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """path, first and end of the byte ranges of the files: a range owns the records from `first`, which is never inside a member.

    A stored block can hold a gzipped record, which a range that begins inside its member would take for one of the file's. But
    the range with that member's start scans on to the next member's. So each range is scanned beyond its end for where the next
    member begins, and a range owns nothing before the furthest such place of the ranges before it.
    """
    spark: SparkSession = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "begin", F.least(F.col("begin") + split_bytes, F.col("bytes")).alias("end"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                after = next_start(path, begin, end)
                yield pa.RecordBatch.from_pydict({"path": [path], "begin": [begin], "end": [end], "after": pa.array([after], pa.int64())})

    followed = map_arrow(ranges.repartition(tasks, "path", "begin"), follow, "path string, begin long, end long, after long")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # At the file's end nothing is left for the ranges behind.
    furthest = F.max(F.coalesce("after", F.lit(1 << 62))).over(before)
    owned = followed.select("path", F.greatest("begin", F.coalesce(furthest, F.lit(0))).alias("first"), "end").where("first < end")
    return stored(owned, "warc-ranges").repartition(tasks, "path", "first")


def read_warc(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Reads archives listed as (path, bytes), in byte ranges of `split_bytes`.

    Returns path, offset, record_type, record_id, url, refers_to, payload_digest (as in the header), payload_bytes (of the full
    payload, by the HTTP header), payload (null for revisits). No files give no rows. A length that can't be read counts as the
    length of what is there; header names are compared without case; members that aren't WARC records are passed over.
    """
    schema = "path string, offset long, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for offset, h, block in records_in_range(path, first, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = h.get("warc-type", "")
                    rows.append((path, offset, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), _length(_fields(http).get("content-length"), len(payload)), None if kind == "revisit" else payload))
                    held += len(payload)
                    if len(rows) >= 500 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(owned_ranges(files, split_bytes), read, schema)
