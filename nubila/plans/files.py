"""Registered queries of the sources and sinks: tables are written to the shared folder, read back and compared by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nubila.functions.core import new_path, ranked
from nubila.plans.queries import LIGHT, PTS, points, query, shaped, table, wavelengths
from nubila.sources import lines, tables, text


def written_lines(spark, rows, name):
    """A text file of rows (place, value), its lines in order of place, as parts that follow each other."""
    path = new_path(spark, name)
    rows.orderBy("place").select("value").write.text(path)
    return path


@query(f"WITH {PTS} SELECT id, id % 7 AS frame, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, 110.0::DOUBLE AS sigma_x FROM pts")
def csv_round_trip(spark, d):
    """Localizations written under the file's column names and read by name, with a constant column."""
    path = new_path(spark, "localizations")
    tables.write_localizations(points(spark, d).select("id", (F.col("id") % 7).alias("frame"), "x", "y", "z"), path)
    return shaped(tables.read_localizations(spark, path, sigma_x=110.0), "id frame", "x y z sigma_x")


@query(f"WITH {PTS} SELECT round(x, 6) AS u, round(z, 6) AS v FROM pts")
def csv_by_position(spark, d):
    path = new_path(spark, "positions")
    tables.write_localizations(points(spark, d).select("id", "x", "y", "z"), path)
    return shaped(tables.read_by_position(spark, path, {2: "u", 4: "v"}), "", "u v")


@query("SELECT p_size::DOUBLE AS wavelength, round(avg(p_retailprice), 6) AS intensity FROM part GROUP BY p_size")
def spectrum_file(spark, d):
    path = new_path(spark, "spectrum")
    rows = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("intensity"))
    rows.select("p_size", F.lit(1).alias("other"), "intensity").write.option("header", True).csv(path)
    return shaped(tables.read_spectrum(spark, path), "", "wavelength intensity")


@query(f"WITH {LIGHT} SELECT id, wavelength FROM w UNION ALL SELECT id, wavelength FROM w WHERE wavelength > 700")
def named_results(spark, d):
    """A named result written, added to and read back."""
    folder, w = new_path(spark, "results"), wavelengths(spark, d)
    tables.write_result(w, folder, "light")
    tables.write_result(w.where("wavelength > 700"), folder, "light", append=True)
    return tables.read_result(spark, folder, "light")


@query(f"WITH {PTS} SELECT round(x, 6) AS c1, round(y, 6) AS c2, round(z, 6) AS c3 FROM pts")
def coordinates_file(spark, d):
    """Coordinates written without a header; the reader finds delimiter and columns by itself."""
    path = new_path(spark, "coordinates")
    tables.write_coordinates(points(spark, d), path)
    return shaped(text.read_matrix(spark, path), "", "c1 c2 c3")


@query("""SELECT -4611686018427387905 AS place, count(*)::VARCHAR AS value FROM part UNION ALL SELECT -4611686018427387904, 'particles'
UNION ALL SELECT p_partkey, p_type || ' ' || p_size::VARCHAR || ' ' || (p_partkey % 10)::VARCHAR || ' 0 ' || CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN '0.25' ELSE '0.8' END FROM part""")
def particle_file(spark, d):
    part = table(spark, d, "part")
    clear = {part.agg(F.min("p_type")).first()[0]: 0.25}
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("species"), F.col("p_size").alias("x"), (F.col("p_partkey") % 10).alias("y"), F.lit(0).alias("z"))
    return tables.xyz_lines(rows, transparency=clear)


@query("""WITH g AS (SELECT l_linenumber AS frame, floor(l_quantity / 5)::BIGINT AS ix, floor(l_extendedprice / 5000)::BIGINT AS iy, count(*) AS v FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT DISTINCT frame FROM g), c AS (SELECT f.frame, x.i AS ix, y.i AS iy FROM f, (SELECT unnest(range(0, 11)) AS i) x, (SELECT unnest(range(0, 24)) AS i) y),
p AS (SELECT c.frame, string_agg(printf('%02x%02x', least(coalesce(v, 0), 65535) & 255, least(coalesce(v, 0), 65535) >> 8), '' ORDER BY c.iy, c.ix) AS pixels FROM c LEFT JOIN g ON g.frame = c.frame AND g.ix = c.ix AND g.iy = c.iy GROUP BY c.frame)
SELECT frame::BIGINT AS frame, (8 + 11 * 24 * 2 + 2 + 9 * 12 + 4)::BIGINT AS bytes, md5(pixels) AS pixels FROM p""")
def tiff_pages(spark, d):
    pixels = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), F.floor(F.col("l_quantity") / 5).alias("ix"), F.floor(F.col("l_extendedprice") / 5000).alias("iy")).agg(F.count("*").alias("value"))
    pages = tables.tiff_pages(pixels, 11, 24)
    return pages.select(F.col("frame").cast("long").alias("frame"), F.length("tiff").cast("long").alias("bytes"), F.md5(F.lower(F.hex(F.substring("tiff", 9, 11 * 24 * 2)))).alias("pixels"))


@query("""WITH g AS (SELECT l_orderkey % 100 AS frame, floor(l_quantity / 5)::BIGINT AS ix, floor(l_extendedprice / 5000)::BIGINT AS iy, count(*) AS value FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS k FROM (SELECT DISTINCT frame FROM g))
SELECT p.k // 30 + 1 AS file, p.k % 30 + 1 AS page, ix, iy, value::BIGINT AS value FROM g JOIN p ON g.frame = p.frame""")
def tiff_stack(spark, d):
    """Files of thirty pages each, read back page by page by their chained directories."""
    pixels = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("frame"), F.floor(F.col("l_quantity") / 5).alias("ix"), F.floor(F.col("l_extendedprice") / 5000).alias("iy")).agg(F.count("*").alias("value"))
    return shaped(tables.tiff_pixels(tables.tiff_stacks(pixels, 11, 24, per_file=30)), "file page ix iy value")


HEADER = [(-2, "supplier accounts"), (-1, "key; balance")]


@query("SELECT s_suppkey::DOUBLE AS c1, round(s_acctbal, 2) AS c2 FROM supplier")
def reader_matrix(spark, d):
    """Header, delimiter, decimal comma and columns found by the reader."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), F.concat_ws("; ", F.col("s_suppkey").cast("string"), F.replace(F.format_string("%.2f", "s_acctbal"), F.lit("."), F.lit(","))).alias("value"))
    path = written_lines(spark, rows.unionByName(spark.createDataFrame(HEADER, "place long, value string")), "matrix")
    return shaped(text.read_matrix(spark, path), "", "c1 c2")


@query("WITH v AS (SELECT s_suppkey * 3 + i AS k, s_suppkey * 10 + i AS v FROM supplier, (SELECT unnest(range(0, 3)) AS i)) SELECT (k // 4 + 1)::BIGINT AS line, max(v) FILTER (WHERE k % 4 = 0)::DOUBLE AS c1, max(v) FILTER (WHERE k % 4 = 1)::DOUBLE AS c2, max(v) FILTER (WHERE k % 4 = 2)::DOUBLE AS c3, max(v) FILTER (WHERE k % 4 = 3)::DOUBLE AS c4 FROM v GROUP BY k // 4")
def reader_blocks(spark, d):
    """Three numbers a line dealt again into rows of four."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("place"), F.concat_ws(" ", *[(k * 10 + i).cast("string") for i in range(3)]).alias("value"))
    path = written_lines(spark, rows, "blocks")
    return shaped(text.read_matrix(spark, path, columns=4, header_lines=0, delimiter=" ", mode="block"), "line", "c1 c2 c3 c4")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS line, s_suppkey * 7 AS code, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS balance FROM supplier WHERE s_suppkey % 11 <> 0")
def reader_formats(spark, d):
    """A hexadecimal column, one that is skipped, gaps that become null, and lines with a bad marker left out."""
    k = F.col("s_suppkey")
    # Digits in lower case: 2989 is BAD in upper case.
    fields = [F.concat(F.lit("0x"), F.lower(F.hex(k * 7))), F.lit("skipped"), F.when(k % 5 == 0, "").otherwise(F.format_string("%.2f", "s_acctbal")), F.when(k % 11 == 0, "BAD").otherwise("")]
    path = written_lines(spark, table(spark, d, "supplier").select(k.alias("place"), F.concat_ws(";", *fields).alias("value")), "formats")
    lines = text.clean_lines(text.read_lines(spark, path), bad=["BAD"])
    parsed = text.parse_columns(lines, 3, ";", ["hex", "skip", "double"], ["code", "other", "balance"])
    # The lines that are kept are numbered again, whichever were left out.
    return shaped(ranked(parsed.withColumnRenamed("line", "place"), "place", rank="line"), "line code", "balance")


@query("SELECT row_number() OVER (ORDER BY CASE o_orderkey % 50 WHEN 7 THEN 0 WHEN 8 THEN 2 ELSE 1 END, o_orderkey) AS line, o_orderkey::VARCHAR || ' ' || o_orderpriority AS value FROM orders")
def line_numbers(spark, d):
    """Numbers over parts of very unequal size, of which Spark reads the largest first."""
    path, k = new_path(spark, "numbers"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("place"), F.concat_ws(" ", k.cast("string"), "o_orderpriority").alias("value"))
    for name, part in (("a", rows.where("place % 50 = 7")), ("b", rows.where("place % 50 NOT IN (7, 8)")), ("c", rows.where("place % 50 = 8"))):
        part.orderBy("place").select("value").write.text(f"{path}/{name}")
    return text.read_lines(spark, path)


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS step, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT 3, c_custkey::VARCHAR FROM customer")
def reader_resume(spark, d):
    """Three reads of a growing folder, each from the position where the one before ended."""
    path, position, out = new_path(spark, "growing"), None, None
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"))
    for step, rows in enumerate((orders.where("place % 3 = 0"), orders.where("place % 3 <> 0"), table(spark, d, "customer").select(F.col("c_custkey").alias("place"))), 1):
        rows.select(F.col("place").cast("string").alias("value")).write.mode("append").text(path)
        found, position = lines.read_on(spark, path, position)
        part = found.select(F.lit(step).cast("long").alias("step"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT row_number() OVER (ORDER BY s_suppkey)::BIGINT AS line, s_suppkey * 7 AS c1, round(s_acctbal, 2) AS c2, s_name AS c4 FROM supplier QUALIFY line BETWEEN 3 AND 40")
def reader_format_string(spark, d):
    """Columns by a format string, of a range of rows; the header and the delimiter are found."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("place"), F.concat_ws(";", F.hex(k * 7), F.format_string("%.2f", "s_acctbal"), F.lit("9"), "s_name").alias("value"))
    path = written_lines(spark, rows, "formatted")
    out = text.read_matrix(spark, path, header_lines=0, delimiter=";", format_string="%x;%f;%*d;%s", rows=(3, 40))
    return shaped(out, "line c1", "c2", "c4")
