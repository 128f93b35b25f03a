"""Document fingerprints by a threshold-scaled sketch, with DataFrame functions only.

A text's sketch holds every hash of its word shingles that lies in the lowest `fraction` of the hash range, and the `least`
smallest ones wherever they lie, so short texts keep all. The threshold is the same for all documents, so a sketch grows with
its document, sketches merge by union, and containment can be estimated between documents of very unequal sizes. Two sketches
are compared up to the hash below which both are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRACTION = 0.25
SHINGLE = 5
#: Hashes that a sketch has at least, if the text has so many shingles.
LEAST = 64
TOP = (1 << 63) - 1


def words(text: Column) -> Column:
    """Lower-cased maximal runs without white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _limit(fraction: float) -> int:
    return -(1 << 63) + int(fraction * (1 << 64))


def _retained(hashes: Column, fraction: float, least: int) -> Column:
    return F.filter(F.sort_array(F.array_distinct(hashes)), lambda h, i: (i < least) | (h < F.lit(_limit(fraction))))


def sketch(words_column: str, fraction: float = FRACTION, size: int = SHINGLE, least: int = LEAST) -> Column:
    """Sorted retained hashes of the shingles of a words column.

    Fewer words than `size`: the whole sequence is the one shingle. Empty only if there are no words.
    """
    w = F.col(words_column)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    whole = F.slice(hashes, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return F.when(F.size(w) >= size, _retained(whole, fraction, least)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def written(hashes: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def _known(hashes: Column, fraction: float, least: int) -> Column:
    """The hash up to which a sketch is complete: all of them if it has fewer than `least`."""
    return F.when(F.size(hashes) < least, F.lit(TOP)).otherwise(F.greatest(F.lit(_limit(fraction) - 1), F.get(hashes, F.size(hashes) - 1)))


def _compared(a: Column, b: Column, fraction: float, least: int) -> tuple[Column, Column, Column]:
    """How many hashes a, b and both have up to where both are complete."""
    known = F.least(_known(a, fraction, least), _known(b, fraction, least))
    return tuple(F.size(F.filter(x, lambda h: h <= known)) for x in (a, b, F.array_intersect(a, b)))


def likeness(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated Jaccard similarity of the shingle sets, exact if both have fewer than `least`; texts without words are alike."""
    n, m, common = _compared(a, b, fraction, least)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / F.greatest(n + m - common, F.lit(1)))


def containment(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated share of a's shingles that b has; a text without words is contained in anything.

    Null if all hashes of a short text lie above those that the other's sketch retains, so nothing is known.
    """
    n, _, common = _compared(a, b, fraction, least)
    return F.when(F.size(a) == 0, 1.0).when(n > 0, common / F.greatest(n, F.lit(1)))


def merged(sketches: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the union of documents, from an array of sketches."""
    return _retained(F.flatten(sketches), fraction, least)


def fingerprint_documents(docs: DataFrame, fraction: float = FRACTION, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, text (null: empty), sketch. Equal texts have equal sketches; other columns are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("__words", words(F.col("text"))).select("doc_id", "text", sketch("__words", fraction, size, least).alias("sketch"))


def with_next(rows: DataFrame, columns: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Adds next_<column>: the values of the row that follows in descending doc_id; the last is followed by the first.

    Rows are dealt into ranges of ids that end at ids of the table, so the row after a range's last one is known beforehand and
    is sent there as a guest; no task sees the whole table. Equal ids are ordered by their text. Null ids come last.
    """
    spark = rows.sparkSession
    ranges = ranges or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.select(key.alias("k")).agg(F.percentile_approx("k", shares, 20 * ranges).alias("ends"), F.max("k").alias("top")).first()
    ends, top = sorted(set(found["ends"] or [])), found["top"]
    bounds = F.array(*[F.lit(e) for e in ends]).cast("array<bigint>")
    below = F.size(F.filter(bounds, lambda e: e < F.col("__key")))
    own = F.struct(below.alias("range"), F.lit(False).alias("guest"))
    after = F.when(F.array_contains(bounds, F.col("__key")), F.struct((below + 1).alias("range"), F.lit(True).alias("guest")))
    first = F.when(F.col("__key") == F.lit(top), F.struct(F.lit(0).alias("range"), F.lit(True).alias("guest")))
    dealt = rows.withColumn("__key", key).withColumn("__in", F.explode(F.array_compact(F.array(own, after, first))))
    dealt = dealt.withColumn("__range", F.col("__in.range")).withColumn("__guest", F.col("__in.guest")).drop("__in")
    order = Window.partitionBy("__range").orderBy("__guest", F.desc("__key"), "text")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("__guest")).drop("__guest", "__range", "__key")
