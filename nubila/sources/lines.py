"""Numbered lines of text files, read by byte ranges, and reading on from a position.

The files are dealt into byte ranges that depend on the files alone, not on the cluster or the session, so that two passes over them
meet the same ranges. The first pass counts line ends in each range; summed up in the order of file names and offsets, the counts
give each range the number of its first line. The second pass, a Python data source with one partition for each range, reads the
lines. A range owns the lines that start in it and reads past its end to finish the last one. What reaches the driver is one row of
numbers for each range, of which there are RANGES and one for each file at most.

A position holds, for each file, the offset after its last finished line and the lines up to it: reading on from it gives the lines
that have come since, with the numbers that a whole read gives them.

Files are listed by Hadoop's file systems, so patterns and folders work as everywhere in Spark, and opened by `pyarrow.fs`.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Least bytes of a range, and ranges at most besides one for each file.
LEAST_RANGE, RANGES = 16 << 20, 50_000
#: Bytes read at once.
BLOCK = 1 << 20
#: The end of a compressed file, whose size isn't known.
OPEN_END = 1 << 62
#: Rows of the first pass: ends of lines of a range's first and second kind, the offset after the last of each, the bytes' end.
COUNTED = "place int, first long, second long, after_first long, after_second long, seen long"
LINES = "file string, offset long, number long, line long, value string"
PACKED = (".gz", ".bz2", ".zst")


@dataclass(frozen=True)
class Range:
    """Bytes [begin, end) of a file; the lines before it in the file and in the whole read; whether an unfinished last line counts."""

    file: str
    begin: int
    end: int
    before: int = 0
    before_all: int = 0
    unfinished: bool = True


@dataclass
class Position:
    """For each file the offset after its last finished line, the finished lines up to it, and the byte that ends its lines."""

    files: dict[str, tuple[int, int, str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.files, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Position:
        return cls({k: tuple(v) for k, v in json.loads(text).items()})


def opened(uri: str, offset: int):
    """A stream of the file's bytes, from an offset; compressed files (by name) are unpacked and count unpacked bytes."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if not uri.endswith(PACKED):
        source = files.open_input_file(path)
        source.seek(offset)
        return source
    stream = files.open_input_stream(path, compression="detect")
    while offset > 0 and (skipped := len(stream.read(min(offset, BLOCK)))):
        offset -= skipped
    return stream


def count_range(r: Range, ends: Sequence[bytes]) -> list[int]:
    """Ends of lines of either kind that lie in the range, the offset after the last one of each (-1: none), and its end."""
    counts, last, at = [0, 0], [-1, -1], r.begin
    with opened(r.file, at) as source:
        while at < r.end and (part := source.read(min(BLOCK, r.end - at))):
            for i, end in enumerate(ends):
                counts[i] += part.count(end)
                last[i] = at + part.rfind(end) + 1 if end in part else last[i]
            at += len(part)
    return [*counts, *last, at]


def read_range(r: Range, end: bytes) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and bytes of the lines that start in the range, in blocks; a carriage return before a line feed isn't part of a line."""
    at, owned, rest = max(r.begin - 1, 0), r.begin == 0, []
    with opened(r.file, at) as source:
        while at < r.end:
            part = source.read(BLOCK)
            if not part:
                if rest and owned and r.unfinished:
                    yield [at], [b"".join(rest)]
                return
            if not owned:
                # The line that the range begins in isn't its own.
                skipped = part.find(end) + 1
                at, part, owned = at + (skipped or len(part)), part[skipped:], bool(skipped)
                if not owned:
                    continue
            lines = part.split(end)
            if len(lines) == 1:
                rest.append(part)
                continue
            lines[0], rest, offsets = b"".join([*rest, lines[0]]), [lines.pop()], []
            for line in lines:
                offsets.append(at)
                at += len(line) + 1
            own = bisect_left(offsets, r.end)
            if end == b"\n":
                lines = [x[:-1] if x.endswith(b"\r") else x for x in lines[:own]]
            if own:
                yield offsets[:own], lines[:own]
            rest = [x for x in rest if x]


class _Part(InputPartition):
    def __init__(self, place: int, given: Range, end: str):
        self.place, self.range, self.end = place, given, end


def _batch(schema: str, *columns: Sequence) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ends = json.loads(options.get("ends", "[]"))
        self.parts = [_Part(i, Range(*r), end) for i, (r, end) in enumerate(json.loads(options["ranges"]))]

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        r = partition.range
        if self.ends:
            yield _batch(COUNTED, *[[v] for v in (partition.place, *count_range(r, [e.encode() for e in self.ends]))])
            return
        seen = 0
        for offsets, found in read_range(r, partition.end.encode()):
            n = len(found)
            numbers = [range(before + seen + 1, before + seen + n + 1) for before in (r.before, r.before_all)]
            yield _batch(LINES, [r.file] * n, offsets, *numbers, [x.decode("utf-8", "replace") for x in found])
            seen += n


class LineSource(DataSource):
    """Lines of byte ranges (option `ranges`), or how many ends of lines (option `ends`) each range has."""

    @classmethod
    def name(cls) -> str:
        return "nubila_lines"

    def schema(self) -> str:
        return COUNTED if self.options.get("ends") else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _source(spark: SparkSession, ranges: Sequence[tuple[Range, str]], ends: Sequence[str] = ()) -> DataFrame:
    if not ranges:
        return spark.createDataFrame([], COUNTED if ends else LINES)
    if not getattr(spark, "_nubila_lines", False):
        spark.dataSource.register(LineSource)
        spark._nubila_lines = True
    options = {"ranges": json.dumps([(astuple(r), end) for r, end in ranges])} | ({"ends": json.dumps(ends)} if ends else {})
    return spark.read.format("nubila_lines").options(**options).load()


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URI and bytes of the files of a path, folder or pattern, by name; names that begin with _ or . inside folders are passed over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    waiting, found = [(s, True) for s in system.globStatus(place) or []], []
    if not waiting:
        raise FileNotFoundError(path)
    while waiting:
        status, named = waiting.pop()
        if not named and status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            waiting += [(s, False) for s in system.listStatus(status.getPath())]
        elif status.getLen():
            uri = status.getPath().toUri().toString()
            found.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, status.getLen()))
    return sorted(found)


def planned(files: Sequence[tuple[str, int]], after: Position, range_bytes: int | None = None) -> list[Range]:
    """The ranges of what lies after a position; they end at whole multiples, wherever the position lies. Packed files are one each."""
    width = range_bytes or max(LEAST_RANGE, sum(n for _, n in files) // RANGES)
    out = []
    for uri, n in files:
        start = after.files.get(uri, (0, 0, ""))[0]
        if not uri.endswith(PACKED) and n < start:
            raise ValueError(f"{uri} has {n} bytes, of which {start} had been read")
        edges = [start, OPEN_END] if uri.endswith(PACKED) else [start, *range((start // width + 1) * width, n, width), n]
        out += [Range(uri, a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
    return out


@dataclass
class LineIndex:
    """Ranges with the lines before them and their line end, the position after the last finished line, and the lines in all."""

    ranges: list[tuple[Range, str]]
    position: Position
    lines: int

    def within(self, low: int, high: int) -> LineIndex:
        """Only the ranges that can hold lines low to high of the whole read."""
        after = [r.before_all for r, _ in self.ranges[1:]] + [self.lines]
        return LineIndex([(r, end) for (r, end), n in zip(self.ranges, after, strict=True) if r.before_all < high and n >= low], self.position, self.lines)


def line_index(spark: SparkSession, path: str, line_sep: str | None = None, after: Position | None = None, unfinished: bool = True, range_bytes: int | None = None) -> LineIndex:
    """Counts the lines of all files after a position.

    line_sep: one byte, or None for what each file has: line feeds, with or without carriage returns before them, or where a file
    has none, carriage returns. unfinished: whether a file's last line counts without a line end.
    """
    after, line_sep = after or Position(), "\n" if line_sep == "\r\n" else line_sep
    if line_sep and len(line_sep.encode()) != 1:
        raise ValueError("a line end is one byte")
    ranges, ends = planned(listed(spark, path), after, range_bytes), (line_sep or "\n", line_sep or "\r")
    # One row for each range.
    counted = {r["place"]: r for r in _source(spark, [(r, "") for r in ranges], ends).collect()}
    by_file: dict[str, list[int]] = {}
    for i, r in enumerate(ranges):
        by_file.setdefault(r.file, []).append(i)
    position, out, everywhere = Position(dict(after.files)), [], 0
    for uri, places in by_file.items():
        offset, number, known = after.files.get(uri, (0, 0, ""))
        total = lambda c: sum(counted[i][c] for i in places)  # noqa: B023, E731
        kind = "second" if known == "\r" or (not known and not line_sep and total("second") and not total("first")) else "first"
        end, last, before = ends[kind == "second"], offset, number
        for i in places:
            r, c = ranges[i], counted[i]
            out.append((replace(r, before=before, before_all=everywhere + before - number, unfinished=unfinished), end))
            # A line starts in the range after each line end in it but one at its very end, and at its begin after one there.
            before += c[kind] - (c[f"after_{kind}"] == r.end) + (last == r.begin)
            last = max(last, c[f"after_{kind}"])
        done = number + total(kind)
        everywhere += done - number + (unfinished and last < counted[places[-1]]["seen"])
        position.files[uri] = (last, done, end)
    return LineIndex(out, position, everywhere)


def lines_of(spark: SparkSession, index: LineIndex) -> DataFrame:
    """file, offset, number (in its file), line (in the whole read) and value of an index's lines; numbers count from 1."""
    return _source(spark, index.ranges)


def read_on(spark: SparkSession, path: str, after: Position | None = None, line_sep: str | None = None, range_bytes: int | None = None) -> tuple[DataFrame, Position]:
    """The lines finished since a position, as lines_of, and the position after them, to read on from.

    A last line without a line end is left for the time when it is finished. Files may grow and be added, but not shrink.
    """
    index = line_index(spark, path, line_sep, after, False, range_bytes)
    return lines_of(spark, index), index.position
