"""Readers and writers."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from nubila.sources import lines, tables, text


@pytest.fixture
def file(tmp_path):
    def write(content, name="in.txt"):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    return write


def values(df):
    return [tuple(r)[1:] for r in df.orderBy("line").collect()]


def test_plain_table_and_gaps(spark, file):
    path = file("1 2 3\n4 5\n6 7 8\n")
    assert values(text.read_matrix(spark, path)) == [(1, 2, 3), (4, 5, None), (6, 7, 8)]


def test_header_and_decimal_comma(spark, file):
    path = file("my header\nunits; more\n1,5;2,25\n-3,0;4,5e1\n")
    assert values(text.read_matrix(spark, path)) == [(1.5, 2.25), (-3.0, 45.0)]
    assert text.header_text(text.read_lines(spark, path), 2) == "my header\nunits; more"


def test_hex_columns_with_bad_lines_and_skipping(spark, file):
    path = file("A5 0x1F x 1.5\nB0 comment here\nff 10 y 2.5\n")
    df = text.read_matrix(spark, path, columns=4, header_lines=0, delimiter=" ", kinds=["hex", "hex", "skip", "double"], bad=["comment"])
    assert values(df) == [(165, 31, 1.5), (255, 16, 2.5)]


def test_good_lines_ranges_and_line_functions(spark, file):
    path = file("".join(f"row {i} v {i * i}\n" for i in range(1, 21)))
    lines = text.read_matrix(spark, path, mode="string", header_lines=0, good=["row 1", "row 2 "], rows=(2, 15), select=lambda n: n % 2 == 0)
    assert [r["line"] for r in lines.orderBy("line").collect()] == [2, 10, 12, 14]


def test_replacements_in_order(spark, file):
    path = file("a=1;b=22\na=3;b=44\n")
    df = text.read_matrix(spark, path, columns=2, header_lines=0, delimiter=" ", replace_regex=[("[a-z]=", "")], replace_chars=["; "])
    assert values(df) == [(1, 22), (3, 44)]
    df = text.read_matrix(spark, path, columns=2, header_lines=0, delimiter=" ", replace_text=[(("a=", ";b="), " ")])
    assert values(df) == [(1, 22), (3, 44)]


def test_block_mode_and_growth(spark, file):
    path = file("1 2 3\n4\n5 6\n")
    assert values(text.read_matrix(spark, path, columns=2, header_lines=0, delimiter=" ", mode="block")) == [(1, 2), (3, 4), (5, 6)]
    assert len(text.read_matrix(spark, path, header_lines=0, delimiter=" ", grow=True).columns) == 4


def test_line_numbers_across_parts(spark, file):
    path = file("".join(f"{i}\n" for i in range(1, 30001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert text.read_lines(spark, path).where("line <> cast(value as long)").isEmpty()
        assert text.read_lines(spark, path).count() == 30000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_ends_and_empty_files(spark, file):
    assert text.read_lines(spark, file("a\r\nb\r\n")).count() == 2
    assert text.read_lines(spark, file("a\rb", "cr.txt"), "\r").count() == 2
    assert text.read_matrix(spark, file("", "empty.txt"), columns=2).count() == 0


def test_intervals(spark):
    rows = spark.range(1, 21).select(F.col("id").alias("line"))
    spans = spark.createDataFrame([(2, 4), (9, 9)], "low long, high long")
    assert sorted(r[0] for r in text.in_intervals(rows, spans).collect()) == [2, 3, 4, 9]
    assert text.in_intervals(rows, spans, keep=False).count() == 16


def test_localizations_round_trip(spark, file, tmp_path):
    path = file('id,frame,"x [nm]","y [nm]","sigmax [nm]","centroid [nm]","z [nm]",extra\n1,7,1.5,2,110,680,NaN,9\n2,8,3,4,120,700,-5,8\n')
    df = tables.read_localizations(spark, path, channel="C1")
    assert [tuple(r) for r in df.select("id", "frame", "x", "z", "wavelength", "extra", "channel").orderBy("id").collect()] == [(1, 7, 1.5, None, 680.0, 9.0, "C1"), (2, 8, 3.0, -5.0, 700.0, 8.0, "C1")]
    tables.write_localizations(df.drop("channel"), str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_localizations(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.drop("channel").collect())) or df.count() == 2
    tables.write_result(df, str(tmp_path), "points")
    tables.write_result(df, str(tmp_path), "points", append=True)
    assert tables.read_result(spark, str(tmp_path), "points").count() == 4
    assert [tuple(r) for r in tables.read_spectrum(spark, path).orderBy("wavelength").collect()] == [(1.0, 1.5), (2.0, 3.0)]


def test_particles_and_images(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 1.0, 2.0, 3.0), (2, "B", 4.0, 5.0, 6.0)], "id long, species string, x double, y double, z double")
    tables.write_xyz(df, str(tmp_path / "xyz"), transparency={"B": 0.0})
    lines = "".join(p.read_text() for p in sorted((tmp_path / "xyz").glob("part-*"))).splitlines()
    assert lines == ["2", "particles", "A 1.0 2.0 3.0 0.8", "B 4.0 5.0 6.0 0.0"]
    tables.write_coordinates(df, str(tmp_path / "ascii"))
    assert "1.0 2.0 3.0" in "".join(p.read_text() for p in (tmp_path / "ascii").glob("part-*"))
    page = tables.tiff_pages(spark.createDataFrame([(1, 2, 1, 500.0), (1, 0, 0, 70000.0)], "frame int, ix int, iy int, value double"), 3, 2).first()["tiff"]
    assert bytes(page[:4]) == b"II*\0" and struct.unpack("<6H", bytes(page[8:20])) == (65535, 0, 0, 0, 0, 500)


def test_files_of_many_pages(spark):
    """Pages in the key's order, chained in files; a file alone equals what a plain reader of its directories sees."""
    rows = [(f * 3, x, y, f * 10 + x + y) for f in range(7) for x in range(4) for y in range(3) if (f + x + y) % 2]
    stacks = tables.tiff_stacks(spark.createDataFrame(rows, "frame int, ix int, iy int, value int").repartition(4), 4, 3, per_file=3)
    assert [(r["file"], r["first"], r["pages"]) for r in stacks.orderBy("file").collect()] == [(1, 1, 3), (2, 4, 3), (3, 7, 1)]
    got = {((r["file"] - 1) * 3 + r["page"] - 1, r["ix"], r["iy"], r["value"]) for r in tables.tiff_pixels(stacks).collect()}
    assert got == {(f // 3, x, y, v) for f, x, y, v in rows if v}
    one = bytes(tables.tiff_stacks(spark.createDataFrame([(1, 2, 1, 500.0)], "frame int, ix int, iy int, value double"), 3, 2).first()["tiff"])
    assert one == bytes(tables.tiff_pages(spark.createDataFrame([(1, 2, 1, 500.0)], "frame int, ix int, iy int, value double"), 3, 2).first()["tiff"])
    with pytest.raises(ValueError, match="4 GB"):
        tables.tiff_stacks(spark.createDataFrame([], "frame int, ix int, iy int, value double"), 5000, 5000)


def test_columns_of_late_wide_lines_are_kept(spark, tmp_path):
    path = tmp_path / "wide.txt"
    path.write_text("\n".join(["1 2"] * 500 + ["3 4 5"]))
    rows = text.read_matrix(spark, str(path)).collect()
    assert len(rows) == 501 and [r["c3"] for r in rows if r["c3"] is not None] == [5.0]
    assert "c3" not in text.read_matrix(spark, str(path), columns=2).columns


def test_blocks_and_intervals_over_many_lines(spark, monkeypatch):
    monkeypatch.setattr(text, "LINES", 7)
    monkeypatch.setattr(text, "BUCKET", 5)
    lines = spark.createDataFrame([(i, " ".join(str(10 * i + k) for k in range(i % 4))) for i in range(1, 60)], "line long, value string").repartition(5)
    flat = [float(10 * i + k) for i in range(1, 60) for k in range(i % 4)]
    got = sorted(tuple(r) for r in text.flatten_blocks(lines, 5).collect())
    assert [v for r in got for v in r[1:] if v is not None] == flat and [r[0] for r in got] == list(range(1, len(got) + 1))
    spans = spark.createDataFrame([(3, 4), (10, 31), (50, 50)], "low long, high long")
    inside = {3, 4, 50, *range(10, 32)}
    assert {r["line"] for r in text.in_intervals(lines, spans).collect()} == inside
    assert {r["line"] for r in text.in_intervals(lines, spans, keep=False).collect()} == set(range(1, 60)) - inside
    assert text.in_intervals(lines, spans.limit(0)).count() == 0 and text.in_intervals(lines, spans.limit(0), keep=False).count() == 59


def numbered(folder, name_order):
    """file name, offset, number in the file, number of all, text of each line, by plain Python."""
    out, n = [], 0
    for name in name_order:
        raw, at = (folder / name).read_bytes(), 0
        ends = b"\n" if b"\n" in raw or b"\r" not in raw else b"\r"
        parts = raw.split(ends)
        for k, part in enumerate(parts if parts[-1] else parts[:-1]):
            n += 1
            out.append((name, at, k + 1, n, part.removesuffix(b"\r").decode()))
            at += len(part) + 1
    return out


def as_tuples(df):
    return sorted((r["file"].rpartition("/")[2], r["offset"], r["number"], r["line"], r["value"]) for r in df.collect())


def test_line_numbers_over_unequal_parts(spark, tmp_path):
    """Spark reads the largest part first; numbers follow the names, whatever the byte ranges and the session's splits."""
    folder = tmp_path / "parts"
    folder.mkdir()
    for name, n in (("a", 3), ("b", 5000), ("c", 100), ("_hidden", 7)):
        (folder / name).write_text("".join(f"{name} {i} {'x' * (i % 17)}\n" for i in range(n)))
    (folder / "d").write_bytes(b"one\r\ntwo\r\n\r\nlast, unfinished")
    (folder / "e").write_bytes(b"only\rreturns\rhere")
    (folder / "f").write_bytes(b"")
    want = numbered(folder, "abcde")
    for size in (1, 7, 64, 1000, None):
        if size == 1:
            index = lines.line_index(spark, str(folder / "d"), range_bytes=1)
            assert as_tuples(lines.lines_of(spark, index)) == sorted(numbered(folder, "d"))
            continue
        index = lines.line_index(spark, str(folder), range_bytes=size and size * 40)
        assert as_tuples(lines.lines_of(spark, index)) == sorted(want) and index.lines == len(want)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = text.read_lines(spark, str(folder)).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line"], r["value"]) for r in got] == [(n, v) for _, _, _, n, v in want]
    assert [r["line"] for r in text.read_lines(spark, str(folder), rows=(5001, 5004)).orderBy("line").collect()] == [5001, 5002, 5003, 5004]


def test_ranges_outside_the_wanted_rows_are_not_read(spark, file):
    path = file("".join(f"{i}\n" for i in range(1, 2001)))
    index = lines.line_index(spark, path, range_bytes=500)
    near = index.within(1000, 1003)
    assert len(index.ranges) > 15 and 1 <= len(near.ranges) <= 2
    assert {1000, 1001, 1002, 1003} <= {r["line"] for r in lines.lines_of(spark, near).collect()}
    assert index.within(3000, 4000).ranges == [] and lines.lines_of(spark, index.within(3000, 4000)).count() == 0


def test_reading_on_equals_the_tail_of_a_whole_read(spark, tmp_path):
    """Positions kept as text; lines are taken once they are finished, each once, with the numbers of a whole read."""
    folder = tmp_path / "logs"
    folder.mkdir()
    steps = [{"a": b"1\n2\n3"}, {"a": b"4 goes on\n5\n"}, {}, {"b": b"x\r\n" * 50 + b"y"}, {"a": b"6\n", "b": b"\r\nz\r\n"}, {"c": b"no end"}]
    position, got = lines.Position(), []
    for step in steps:
        for name, more in step.items():
            with (folder / name).open("ab") as f:
                f.write(more)
        df, position = lines.read_on(spark, str(folder), lines.Position.from_json(position.to_json()), range_bytes=16)
        new = [(r["file"].rpartition("/")[2], r["offset"], r["number"], r["value"]) for r in df.collect()]
        assert bool(new) == (step not in ({}, {"c": b"no end"}))
        got += new
    assert sorted(got) == sorted((f, o, k, v) for f, o, k, _, v in numbered(folder, "ab"))
    (folder / "a").write_bytes(b"1\n")
    with pytest.raises(ValueError, match="had been read"):
        lines.read_on(spark, str(folder), position)


def test_packed_files_other_ends_and_very_long_lines(spark, tmp_path):
    rows = [f"row {i}" for i in range(3000)]
    (tmp_path / "p.txt.gz").write_bytes(gzip.compress("\n".join(rows).encode()))
    assert [r["value"] for r in text.read_lines(spark, str(tmp_path / "p.txt.gz")).orderBy("line").collect()] == rows
    (tmp_path / "s.txt").write_text("a|b|c")
    assert [r["value"] for r in text.read_lines(spark, str(tmp_path / "s.txt"), "|").orderBy("line").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="one byte"):
        text.read_lines(spark, str(tmp_path / "s.txt"), "ab")
    with pytest.raises(FileNotFoundError):
        text.read_lines(spark, str(tmp_path / "absent"))
    (tmp_path / "long.txt").write_text("s\n" + "y" * 5_000_000 + "\nt\n")
    index = lines.line_index(spark, str(tmp_path / "long.txt"), range_bytes=300_000)
    assert [(r["line"], len(r["value"])) for r in lines.lines_of(spark, index).orderBy("line").collect()] == [(1, 1), (2, 5_000_000), (3, 1)]


def test_headers_longer_than_any_sample_and_forms(spark, file):
    path = file("".join(f"header {i}\n" for i in range(700)) + "1;2,5;\n3;;4\n" * 400)
    form = text.detect_form(text.read_lines(spark, path))
    assert form == {"header_lines": 700, "delimiter": ";", "decimal_comma": True, "columns": 3}
    got = text.read_matrix(spark, path, rows=(1, 2)).orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 2.5, None), (2, 3.0, None, 4.0)]
    assert text.detect_form(text.read_lines(spark, file("only words\n", "w.txt")))["header_lines"] == 1
    for content, want in (("1,2,3\n", (",", False, 3)), ("1 2\n", (" ", False, 2)), ("1,5 2,5\n", (" ", True, 2)), ("-1e3\tNaN\n", ("\t", False, 2)), ("7\n", (";", False, 1))):
        form = text.detect_form(text.read_lines(spark, file(content * 3, "f.txt")))
        assert (form["delimiter"], form["decimal_comma"], form["columns"]) == want, content


def test_format_strings(spark, file):
    assert text.kinds_of("%f %5.2f,%d %x %*s %s") == ["double", "double", "bigint", "hex", "skip", "string"]
    for wrong in ("%q", "%f %"):
        with pytest.raises(ValueError, match="conversion"):
            text.kinds_of(wrong)
    path = file("1.5 ff skip 7 word\n2.5 0x10 skip 8 other\n")
    df = text.read_matrix(spark, path, header_lines=0, delimiter=" ", format_string="%f %x %*s %d %s")
    assert values(df) == [(1.5, 255, 7, "word"), (2.5, 16, 8, "other")] and dict(df.dtypes)["c4"] == "bigint"


def test_formats_over_keys_with_gaps_and_a_code_that_spells_the_marker(spark, tmp_path):
    """Key 427 gives 0xBAD; the keys left out are not every eleventh line."""
    from nubila.plans.queries import QUERIES

    keys = [1, 5, 11, 12, 40, 427, 428, 990, 1500]
    spark.createDataFrame([(k, k + 0.25) for k in keys], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r[c] for c in ("line", "code", "balance")) for r in QUERIES["reader_formats"](spark, str(tmp_path)).collect()}
    kept = [k for k in keys if k % 11]
    assert got == {(i, k * 7, None if k % 5 == 0 else k + 0.25) for i, k in enumerate(kept, 1)}
