"""Connected components and minimum spanning forests of graphs given as tables of links.

Graphs shrink by randomised contraction: in every round each vertex goes to the neighbour (or stays itself) with the least hash, the
links are renamed and the graph of those that are left is a constant share smaller, in expectation at least a quarter. What is left
with at most RESIDUAL links, a bound that doesn't depend on the input, is finished in one task. The renamings are then followed
backwards, from the smallest to the largest, so all of them together cost no more than the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.functions.core import checkpointed, hot_rows, looked_up

#: Links that one task finishes.
RESIDUAL = 50_000


def _roots(links: Sequence[tuple]) -> dict:
    """The smallest vertex reachable from each vertex of the links."""
    first: dict = {}

    def top(v):
        while first.setdefault(v, v) != v:
            first[v] = v = first[first[v]]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            first[max(a, b)] = min(a, b)
    return {v: top(v) for v in first}


def _finished(links: DataFrame) -> DataFrame:
    """(id, root) of a graph of at most RESIDUAL links."""
    kind = links.schema["a"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = None, []
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (0, 1)]
            kinds = [batch.column(i).type for i in (0, 1)]
            names = names or (list(sides[0][0]) if sides[0] and isinstance(sides[0][0], dict) else None)
            plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
            found += [(plain(a), plain(b)) for a, b in zip(*sides, strict=True)]
        if found:
            roots = _roots(found)
            back = lambda v: dict(zip(names, v, strict=True)) if names else v
            yield pa.RecordBatch.from_arrays([pa.array([back(v) for v in side], kinds[0]) for side in (roots.keys(), roots.values())], names=["id", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(finish, f"id {kind}, root {kind}")


def _renamed(links: DataFrame, side: str, names: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Links with one side renamed by (id, root); a vertex with very many links is dealt by the columns in `spread`."""
    counts = links.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))
    out = looked_up(links.withColumnRenamed(side, "id"), ["id"], names, hot_rows(counts), spread)
    return out.drop("id").withColumnRenamed("root", side)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b). Ids can be of any ordered type.

    Vertices without edges are components of their own; edges to what isn't a vertex count all the same.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    links, renamings, k = checkpointed(ordered.distinct()), [], 0
    while links.count() > RESIDUAL:
        k += 1
        both = links.select("a", "b").union(links.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        chosen = both.groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("to"), F.first(place("a")).alias("own"))
        names = checkpointed(chosen.select("id", F.least("to", "own")["v"].alias("root")))
        renamings.append(names)
        moved = _renamed(_renamed(links, "a", names, ["b"]), "b", names, ["a"])
        links = checkpointed(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = _finished(links)
    if renamings:
        for names in reversed(renamings):
            last = roots.select(F.col("id").alias("root"), F.col("root").alias("end"))
            counts = names.groupBy("root").agg(F.count("*").alias("n"))
            roots = checkpointed(looked_up(names, ["root"], last, hot_rows(counts), ["id"]).select("id", F.coalesce("end", "root").alias("root")))
        # Where the graph was contracted, a root is any vertex of its component.
        least = roots.groupBy("root").agg(F.least(F.min("id"), F.first("root")).alias("least"), F.count("*").alias("n"))
        least = checkpointed(least)
        roots = looked_up(roots, ["root"], least.drop("n"), hot_rows(least.select("root", "n")), ["id"]).select("id", F.col("least").alias("root"))
    alone = vertices.select("id").distinct()
    return alone.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _kruskal(links: DataFrame) -> DataFrame:
    """Links (w, a, b, ca, cb) of at most RESIDUAL that join components in the order of w, a, b."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        first: dict = {}

        def top(v):
            while first.setdefault(v, v) != v:
                first[v] = v = first[first[v]]
            return v

        chosen = []
        for w, a, b, ca, cb in sorted(rows):
            ca, cb = top(ca), top(cb)
            if ca != cb:
                first[ca] = cb
                chosen.append((a, b, w))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in chosen], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "w"])

    return links.select("w", "a", "b", "ca", "cb").coalesce(1).mapInArrow(choose, "a long, b long, w double")


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b, w): the links of the minimum spanning forest of links (a long, b long, w double); of equal ones those of smaller a, b.

    In every round each component takes its least link outwards, the components so joined become one, and of the links between two
    of them the least is kept; their number at least halves.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).where("a <> b")
    rest, chosen = ordered.groupBy("a", "b").agg(F.min("w").alias("w")).select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), None
    rest = checkpointed(rest)
    while rest.count() > RESIDUAL:
        link = F.struct("w", "a", "b", "ca", "cb")
        each = rest.select(F.col("ca").alias("c"), link.alias("link")).union(rest.select(F.col("cb").alias("c"), link.alias("link")))
        best = checkpointed(each.groupBy("c").agg(F.min("link").alias("link")).select("link.*").distinct())
        chosen = best.select("a", "b", "w") if chosen is None else chosen.union(best.select("a", "b", "w"))
        ends = best.select(F.col("ca").alias("id")).union(best.select(F.col("cb").alias("id")))
        names = checkpointed(connected_components(ends, best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("component", "root"))
        for side, other in (("ca", "cb"), ("cb", "ca")):
            rest = _renamed(rest, side, names, ("a", "b", other))
        least = rest.where("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("link"))
        rest = checkpointed(least.select("link.w", "link.a", "link.b", "ca", "cb"))
    last = checkpointed(_kruskal(rest))
    return last if chosen is None else chosen.union(last)
