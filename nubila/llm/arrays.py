"""Linear work on long arrays with DataFrame functions: running values, and pieces of a text by place.

A fold that appends to an array copies it at every step, and a substring is counted from the text's start, so both are quadratic in
the array's length. Here arrays are cut into blocks of about the root of their length; folds and substrings run inside blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(values: Column) -> Column:
    """The array's elements in order, in arrays of about the root of its length; none for an empty array. values is a name."""
    n = F.size(values)
    size = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))), lambda b: b * size < n)
    return F.transform(starts, lambda b: F.slice(values, b * size + 1, size))


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs the fold of all before it, from `start`; step is associative and start its neutral element."""
    zero = F.lit(start).cast("long")

    def fold(block: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(block, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))

    def join(folded: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("before"))
        each = lambda acc, b: F.transform(b["before"], lambda x: step(acc["at"], x))
        whole = F.aggregate(folded, first, lambda acc, b: F.struct(step(acc["at"], b["at"]).alias("at"), F.concat(acc["before"], F.array(each(acc, b))).alias("before")))
        return F.flatten(whole["before"])

    return let(values, lambda v: join(F.transform(in_blocks(v), fold)))


def sums_before(values: Column) -> Column:
    """For each of an array of longs the sum of all before it."""
    return running(values, 0, lambda a, b: a + b)


def pieces(text: Column, spans: Column) -> Column:
    """The texts of spans (start and end in code points, ascending and disjoint) of a text, in order. text is a name."""

    def block(items: Column) -> Column:
        low, high = F.get(items, F.lit(0))["start"], F.get(items, F.size(items) - 1)["end"]
        return F.struct(items.alias("items"), low.alias("low"), F.substring(text, (low + 1).cast("int"), (high - low).cast("int")).alias("part"))

    cut = lambda b: F.transform(b["items"], lambda s: F.substring(b["part"], (s["start"] - b["low"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return let(spans, lambda v: F.flatten(F.transform(F.transform(in_blocks(v), block), cut)))
