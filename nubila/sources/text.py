"""A reader of delimited text with replacements, line filters and gap filling, as one DataFrame plan.

Lines keep their one-based number in the order of file names and places, whatever parts Spark reads (see `lines`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.sources.lines import LineIndex, line_index, lines_of

#: A number as a field, in any case; gaps are fields too.
NUMBER = r"(?i)^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[ed][+-]?[0-9]+)?|[+-]?(?:nan|inf))?$"
#: Delimiters that are tried, and with which of them a comma can be the decimal mark.
DELIMITERS = ((";", False), (";", True), ("\t", False), ("\t", True), (",", False), (" ", False), (" ", True))
#: Lines of a block in flatten_blocks, and least width of a bucket in in_intervals.
LINES, BUCKET = 100_000, 1024


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Lines (line, value) of a file or folder, numbered from 1 in the order of file names and places.

    rows: the first and last line that are wanted; only the byte ranges that hold them are read.
    """
    index = line_index(spark, path, line_sep)
    return _numbered(spark, index, rows)


def _numbered(spark: SparkSession, index: LineIndex, rows: tuple[int, int] | None = None) -> DataFrame:
    lines = lines_of(spark, index.within(*rows) if rows else index).select("line", "value")
    return lines.where(F.col("line").between(*rows)) if rows else lines


def _delimited(delimiter: str) -> str:
    return r"\s+" if delimiter == " " else re.escape(delimiter)


def detect_form(lines: DataFrame) -> dict:
    """Header lines, delimiter, decimal comma and columns of lines (line, value), by what most lines agree with.

    For each delimiter and decimal mark all lines are counted whose fields are numbers or gaps; the first of them ends the header. All
    lines count, in one pass that gives one row. A delimiter at a line's end opens no field.
    """
    each = [F.count("*").alias("n"), F.count_if(F.contains("value", F.lit(","))).alias("commas")]
    for k, (delimiter, comma) in enumerate(DELIMITERS):
        plain = F.translate("value", ",", ".") if comma else F.col("value")
        fields = F.split(F.regexp_replace(F.trim(plain), f"(?:{_delimited(delimiter)})$", ""), _delimited(delimiter), -1)
        good = F.forall(fields, lambda f: F.trim(f).rlike(NUMBER)) & (F.trim("value") != "") & (F.size(fields) > 0)
        each += [F.count_if(good).alias(f"good{k}"), F.min(F.when(good, F.col("line"))).alias(f"first{k}"), F.max(F.when(good, F.size(fields))).alias(f"columns{k}")]
    row, best = lines.agg(*each).first(), (-1.0, None)
    for k, (delimiter, comma) in enumerate(DELIMITERS):
        if row[f"good{k}"]:
            score = row[f"good{k}"] * 100 + min(row[f"columns{k}"], 50) - 10 * comma * (not row["commas"]) - 5 * (delimiter == " ") - comma
            if score > best[0]:
                best = (score, {"header_lines": row[f"first{k}"] - 1, "delimiter": delimiter, "decimal_comma": comma, "columns": row[f"columns{k}"]})
    return best[1] or {"header_lines": row["n"], "delimiter": " ", "decimal_comma": False, "columns": 0}


#: Conversions of a format string and the kinds they mean; with a star the field is left out.
CONVERSIONS = {"f": "double", "g": "double", "e": "double", "d": "bigint", "i": "bigint", "u": "bigint", "x": "hex", "s": "string"}


def kinds_of(format_string: str) -> list[str]:
    """The kinds of columns that a format string names: "%f %x %*s" are a double, a hexadecimal number and a field left out.

    Widths are passed over; what stands between conversions is the delimiter's affair. Other conversions are an error.
    """
    kinds = []
    for star, letter in re.findall(r"%(\*?)[0-9.]*(?:l|h)?([A-Za-z])", format_string):
        if letter.lower() not in CONVERSIONS:
            raise ValueError(f"%{letter} is no conversion")
        kinds.append("skip" if star else CONVERSIONS[letter.lower()])
    if len(kinds) != format_string.count("%"):
        raise ValueError(f"{format_string} has an unknown conversion")
    return kinds


def clean_lines(lines: DataFrame, replace_regex: Sequence[tuple[str, str]] = (), replace_text: Sequence[tuple[Sequence[str], str]] = (), replace_chars: Sequence[str] = (), bad: Sequence[str] = (), good: Sequence[str] = (), select: Callable[[Column], Column] | None = None, rows: tuple[int, int] | None = None, header_lines: int = 0) -> DataFrame:
    """Lines after filters and replacements.

    First the header goes, then lines outside `rows` (numbered after the header), lines that fail `select` (a predicate on that
    number), lines with a bad marker or without a good one; then patterns are replaced, then texts, then characters (each entry's
    last character replaces its others).
    """
    out = lines.where(F.col("line") > header_lines).withColumn("line", F.col("line") - header_lines)
    if rows:
        out = out.where(F.col("line").between(*rows))
    if select:
        out = out.where(select(F.col("line")))
    for marker in bad:
        out = out.where(~F.contains("value", F.lit(marker)))
    if good:
        keep = F.lit(False)
        for marker in good:
            keep = keep | F.contains("value", F.lit(marker))
        out = out.where(keep)
    value = F.col("value")
    for pattern, new in replace_regex:
        value = F.regexp_replace(value, pattern, new)
    for olds, new in replace_text:
        for old in olds:
            value = F.replace(value, F.lit(old), F.lit(new))
    for chars in replace_chars:
        value = F.translate(value, chars[:-1], chars[-1] * (len(chars) - 1))
    return out.withColumn("value", value)


def parse_columns(lines: DataFrame, columns: int, delimiter: str = " ", kinds: Sequence[str] | str = "double", names: Sequence[str] | None = None) -> DataFrame:
    """Fixed columns of each line; missing and unreadable fields are null.

    kinds: a Spark type for each column, "hex" for hexadecimal integers, "skip" to leave it out; or one for all.
    """
    parts = F.split(F.trim(F.col("value")), _delimited(delimiter), -1)
    kinds = [kinds] * columns if isinstance(kinds, str) else list(kinds)
    names = names or [f"c{i + 1}" for i in range(columns)]
    out = []
    for i, (kind, name) in enumerate(zip(kinds, names, strict=True)):
        if kind != "skip":
            field = F.nullif(F.trim(F.get("__parts", F.lit(i))), F.lit(""))
            out.append((F.conv(F.regexp_replace(field, "^0[xX]", ""), 16, 10).cast("bigint") if kind == "hex" else field.try_cast(kind)).alias(name))
    return lines.withColumn("__parts", parts).select("line", *out)


def flatten_blocks(lines: DataFrame, columns: int, delimiter: str = " ") -> DataFrame:
    """All numbers of the lines in order, dealt into rows of so many columns: line, c1, c2, ...

    Line breaks don't matter; each number's place is the sum of the counts before it, by line number.
    """
    split = lines.select("line", F.filter(F.split(F.trim("value"), _delimited(delimiter), -1), lambda p: F.trim(p) != "").alias("p"))
    # Blocks of lines, of which there is one count each, are summed up first; then the lines inside each block.
    split = split.withColumn("__block", F.floor(F.col("line") / LINES))
    sizes = split.groupBy("__block").agg(F.sum(F.size("p")).alias("n"))
    first = sizes.select("__block", F.coalesce(F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum(F.size("p")).over(Window.partitionBy("__block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = split.withColumn("__inside", inside).join(first, "__block").withColumn("__at", F.col("__inside") + F.col("__first"))
    each = before.select("__at", F.posexplode("p").alias("i", "v")).select((F.col("__at") + F.col("i")).alias("k"), F.col("v").try_cast("double").alias("v"))
    rows = each.groupBy(F.floor(F.col("k") / columns).alias("r"))
    return rows.agg(*[F.max(F.when(F.col("k") % columns == i, F.col("v"))).alias(f"c{i + 1}") for i in range(columns)]).select((F.col("r") + 1).alias("line"), *[f"c{i + 1}" for i in range(columns)])


def read_matrix(spark: SparkSession, path: str, columns: int | None = None, header_lines: int | None = None, delimiter: str | None = None, decimal_comma: bool | None = None, kinds: Sequence[str] | str = "double", mode: str = "matrix", line_sep: str | None = None, grow: bool = False, rows: tuple[int, int] | None = None, format_string: str | None = None, **cleaning) -> DataFrame:
    """A text file as a numeric table (mode "matrix", "line", "auto"), re-dealt numbers ("block") or clean lines ("char", "cell", "string").

    What isn't given is found from all lines; the columns are those of the widest line, unless `columns` is given without `grow`.
    rows: first and last line after the header; with the header given, only the byte ranges that hold them are read. format_string
    stands for kinds and columns. See clean_lines for the rest.
    """
    index = line_index(spark, path, line_sep)
    lines = _numbered(spark, index)
    if format_string is not None:
        kinds = kinds_of(format_string)
        columns = len(kinds)
    form = detect_form(lines) if header_lines is None or delimiter is None else {"header_lines": 0, "delimiter": delimiter, "decimal_comma": False}
    header = form["header_lines"] if header_lines is None else header_lines
    delimiter = form["delimiter"] if delimiter is None else delimiter
    if decimal_comma or (decimal_comma is None and form["decimal_comma"]):
        cleaning["replace_chars"] = [*cleaning.get("replace_chars", ()), ",."]
    if rows:
        lines = _numbered(spark, index, (rows[0] + header, rows[1] + header))
    cleaned = clean_lines(lines, header_lines=header, rows=rows, **cleaning)
    if mode in ("char", "cell", "string"):
        return cleaned
    if grow or columns is None:
        # A delimiter at a line's end opens no column.
        parts = F.split(F.regexp_replace(F.trim("value"), f"(?:{_delimited(delimiter)})$", ""), _delimited(delimiter))
        columns = cleaned.agg(F.max(F.size(parts))).first()[0] or 0
    return flatten_blocks(cleaned, columns, delimiter) if mode == "block" else parse_columns(cleaned, columns, delimiter, kinds)


def header_text(lines: DataFrame, header_lines: int) -> str:
    """The header's lines."""
    return "\n".join(r["value"] for r in lines.where(F.col("line") <= header_lines).orderBy("line").collect())


def in_intervals(df: DataFrame, intervals: DataFrame, column: str = "line", keep: bool = True) -> DataFrame:
    """Rows whose number lies in one of the closed, disjoint intervals (low, high), or in none.

    Rows and intervals meet in buckets of numbers as wide as the mean interval, at least BUCKET; an interval is a row in each bucket
    that it covers, so no row is compared with all intervals and no task sees all rows.
    """
    wide = intervals.agg(F.avg(F.col("high") - F.col("low") + 1)).first()[0]
    bucket = max(BUCKET, int(wide or 0))
    spans = intervals.select("low", "high", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))).alias("__bucket"))
    rows = df.withColumn("__bucket", F.floor(F.col(column) / bucket))
    inside = (rows["__bucket"] == spans["__bucket"]) & (rows[column] >= spans["low"]) & (rows[column] <= spans["high"])
    return rows.join(spans, inside, "left_semi" if keep else "left_anti").select(*df.columns)
