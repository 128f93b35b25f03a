"""Density clustering over a grid of cells whose points are all within the radius of each other.

A cell's diagonal is the radius, so all points of a cell with min_samples points or more are core points without a look at their
neighbours, and the core points of a cell are one cluster. Neighbours are counted for the points of sparser cells only: a cell has at
most min_samples - 1 of them, so a crowded cell's points meet a bounded number. Two cells are linked if any core points of theirs are
within the radius; their outermost points and boxes decide most pairs, and pairs of cells that those already put into one component
need no look. Of the rest, small blocks are compared point by point, and others are cut into finer blocks until all are decided.
Components run over cells. No table of pairs of points is made.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubila.functions.core import checkpointed, hot_rows, looked_up, ranked, squared_distance, steps_array
from nubila.operators.graph import connected_components

#: Points of a cell that are a join key of their own.
PART = 20_000
#: Points of the smaller of two blocks that are compared with all of the other; cells of a finer block along each axis.
SMALL, FINER = 16, 4


def offsets(dimensions: int) -> list[tuple[int, ...]]:
    """Steps to the cells that can hold points within the radius, in units of a cell's edge."""
    reach = int(math.sqrt(dimensions)) + 1
    near = lambda step: sum(max(abs(s) - 1, 0) ** 2 for s in step) <= dimensions
    return [s for s in itertools.product(range(-reach, reach + 1), repeat=dimensions) if near(s)]


class CellGrid:
    """Points (keys, id, axes) in cells; a cell is named by keys and __c0, __c1, ..."""

    def __init__(self, points: DataFrame, eps: float, axes: Sequence[str], keys: Sequence[str]):
        self.eps, self.axes, self.keys = float(eps), list(axes), list(keys)
        self.edge = self.eps / math.sqrt(len(self.axes)) * (1 - 1e-9)
        self.places = [f"__c{i}" for i in range(len(self.axes))]
        self.cell = [*self.keys, *self.places]
        own = points.select(*self.keys, "id", *[F.col(a).cast("double").alias(a) for a in self.axes]).dropna(subset=self.axes)
        placed = own.withColumns({c: F.floor(F.col(a) / self.edge) for c, a in zip(self.places, self.axes, strict=True)})
        self.counts = checkpointed(placed.groupBy(*self.cell).agg(F.count("*").alias("n")))
        self.hot = hot_rows(self.counts)
        self.points = checkpointed(looked_up(placed, self.cell, self.counts, self.hot, ["id"]))

    def moved(self, rows: DataFrame, steps: Sequence[tuple[int, ...]], prefix: str = "") -> DataFrame:
        """Each row at every step from its cell, which stays as from0, from1, ..."""
        out = rows.withColumn("__step", F.explode(steps_array(steps, [f"s{i}" for i in range(len(self.axes))])))
        out = out.withColumns({f"{prefix}from{i}": F.col(c) for i, c in enumerate(self.places)})
        return out.withColumns({c: F.col(c) + F.col(f"__step.s{i}") for i, c in enumerate(self.places)}).drop("__step")

    def parts(self, n: Column) -> Column:
        return F.ceil(n / PART).cast("int")

    def within(self, few: DataFrame) -> DataFrame:
        """few (keys, id, axes, cells) beside the points of the cells around: a_ columns of few, b_id, whether b's cell is dense."""
        renamed = few.select(*self.cell, F.col("id").alias("a_id"), *[F.col(a).alias(f"a_{a}") for a in self.axes])
        targets = self.moved(renamed, offsets(len(self.axes))).join(self.counts, self.cell)
        dealt = targets.withColumn("__part", F.explode(F.sequence(F.lit(0), self.parts(F.col("n")) - 1))).drop("n")
        right = self.points.select(*self.cell, F.col("id").alias("b_id"), *[F.col(a).alias(f"b_{a}") for a in self.axes], F.pmod(F.xxhash64("id"), self.parts(F.col("n"))).cast("int").alias("__part"), "n")
        return dealt.join(right, [*self.cell, "__part"]).where(squared_distance("a", "b", self.axes) <= self.eps * self.eps)


def _blocks(core: DataFrame, grid: CellGrid, level: int) -> DataFrame:
    """Blocks of the core points of cells: cell, block (a struct), points, the box around them and the outermost point of each side."""
    size = grid.edge / FINER**level
    block = F.struct(*[F.floor(F.col(a) / size).alias(a) for a in grid.axes])
    box = [f(a).alias(f"{name}_{a}") for a in grid.axes for name, f in (("lo", F.min), ("hi", F.max))]
    place = F.struct(*grid.axes)
    tips = [f(place, F.col(a)).alias(f"{name}_tip_{a}") for a in grid.axes for name, f in (("lo", F.min_by), ("hi", F.max_by))]
    return core.groupBy("rep", block.alias("block")).agg(F.count("*").alias("k"), *box, *tips)


def _least_gap(grid: CellGrid) -> Column:
    out = F.lit(0.0)
    for a in grid.axes:
        gap = F.greatest(F.col(f"b_lo_{a}") - F.col(f"a_hi_{a}"), F.col(f"a_lo_{a}") - F.col(f"b_hi_{a}"), F.lit(0.0))
        out = out + gap * gap
    return out


def _greatest_gap(grid: CellGrid) -> Column:
    out = F.lit(0.0)
    for a in grid.axes:
        gap = F.greatest(F.col(f"b_hi_{a}") - F.col(f"a_lo_{a}"), F.col(f"a_hi_{a}") - F.col(f"b_lo_{a}"))
        out = out + gap * gap
    return out


def _tips_near(grid: CellGrid) -> Column:
    """Whether outermost points that face each other along an axis are within the radius."""
    out = F.lit(False)
    for a in grid.axes:
        for mine, theirs in (("hi", "lo"), ("lo", "hi")):
            d2 = F.lit(0.0)
            for x in grid.axes:
                d = F.col(f"a_{mine}_tip_{a}.{x}") - F.col(f"b_{theirs}_tip_{a}.{x}")
                d2 = d2 + d * d
            out = out | (d2 <= grid.eps * grid.eps)
    return out


def _side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in blocks.columns])


def links_of_cells(core: DataFrame, cells: DataFrame, grid: CellGrid) -> DataFrame:
    """Links (a, b) of cells, named by their least core id `rep`, that have core points within the radius of each other; enough of them
    that all cells so linked are connected.

    core: rep, id and axes of the core points; cells: cell and rep of those that have any.
    """
    half = [s for s in offsets(len(grid.axes)) if s > (0,) * len(grid.axes)]
    near = grid.moved(cells.select(*grid.cell, F.col("rep").alias("a_rep")), half).join(cells.select(*grid.cell, F.col("rep").alias("b_rep")), grid.cell)
    pairs, decided, level = near.select("a_rep", "b_rep"), None, 0
    blocks = checkpointed(_blocks(core, grid, 0))
    pairs = pairs.join(_side(blocks, "a"), "a_rep").join(_side(blocks, "b"), "b_rep")
    while True:
        limit = grid.eps * grid.eps
        judged = pairs.where(_least_gap(grid) <= limit).withColumn("sure", (_greatest_gap(grid) <= limit) | _tips_near(grid))
        judged = checkpointed(judged.select("a_rep", "a_block", "a_k", "b_rep", "b_block", "b_k", "sure"))
        sure = judged.where("sure").select("a_rep", "b_rep").distinct()
        decided = sure if decided is None else decided.union(sure)
        # Pairs of cells that are connected by now need no link of their own.
        ends = decided.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        known = checkpointed(connected_components(ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))), ends))
        rest = judged.where("not sure")
        for side in "ab":
            rest = rest.join(known.select(F.col("id").alias(f"{side}_rep"), F.col("component").alias(f"__{side}")), f"{side}_rep", "left")
        rest = checkpointed(rest.where(~F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).drop("__a", "__b"))
        if rest.isEmpty():
            return decided.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        found = checkpointed(_opened(rest.where(F.least("a_k", "b_k") <= SMALL), core, grid, level))
        decided = decided.union(found)
        rest = rest.where(F.least("a_k", "b_k") > SMALL).join(found, ["a_rep", "b_rep"], "left_anti").select("a_rep", "b_rep", "a_block", "b_block")
        rest = checkpointed(rest)
        if rest.isEmpty():
            return decided.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        level += 1
        waiting = rest.select(F.col("a_rep").alias("rep")).union(rest.select(F.col("b_rep").alias("rep"))).distinct()
        blocks = checkpointed(_blocks(core.join(waiting, "rep", "left_semi"), grid, level))
        outer = F.struct(*[F.floor(F.col(f"block.{a}") / FINER).alias(a) for a in grid.axes])
        inner = blocks.withColumn("outer", outer)
        a = _side(inner, "a").withColumnRenamed("a_outer", "__a")
        b = _side(inner, "b").withColumnRenamed("b_outer", "__b")
        rest = rest.withColumnRenamed("a_block", "__a").withColumnRenamed("b_block", "__b")
        pairs = rest.join(a, ["a_rep", "__a"]).join(b, ["b_rep", "__b"]).drop("__a", "__b")


def _opened(pairs: DataFrame, core: DataFrame, grid: CellGrid, level: int) -> DataFrame:
    """The pairs of cells of which two points within the radius lie in the pairs of blocks; the smaller block of each is small."""
    size = grid.edge / FINER**level
    flat = lambda name: [F.col(f"{name}_rep").alias(f"{name}_rep"), F.col(f"{name}_block").alias(f"{name}_block"), F.col(f"{name}_k").alias(f"{name}_k")]
    turned = F.col("a_k") <= F.col("b_k")
    few = lambda c: F.when(turned, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    many = lambda c: F.when(turned, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    sided = pairs.select(*flat("a"), *flat("b")).select("a_rep", "b_rep", few("rep").alias("few_rep"), few("block").alias("few_block"), many("rep").alias("many_rep"), many("block").alias("many_block"), many("k").alias("many_k"))
    own = core.select("rep", "id", *grid.axes, F.struct(*[F.floor(F.col(a) / size).alias(a) for a in grid.axes]).alias("block"))
    few_points = own.select(F.col("rep").alias("few_rep"), F.col("block").alias("few_block"), *[F.col(a).alias(f"a_{a}") for a in grid.axes])
    spread = sided.join(few_points, ["few_rep", "few_block"]).withColumn("__part", F.explode(F.sequence(F.lit(0), grid.parts(F.col("many_k")) - 1)))
    # A crowded block's points are dealt like its partner's copies.
    sizes = sided.select("many_rep", "many_block", "many_k").distinct()
    many_points = own.select(F.col("rep").alias("many_rep"), F.col("block").alias("many_block"), "id", *[F.col(a).alias(f"b_{a}") for a in grid.axes])
    dealt = looked_up(many_points, ["many_rep", "many_block"], sizes, hot_rows(sizes, "many_k"), ["id"]).where("many_k is not null")
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("id"), grid.parts(F.col("many_k"))).cast("int")).drop("many_k", "id")
    met = spread.drop("many_k").join(dealt, ["many_rep", "many_block", "__part"]).where(squared_distance("a", "b", grid.axes) <= grid.eps * grid.eps)
    return met.select("a_rep", "b_rep").distinct()


def density_clusters(points: DataFrame, eps: float, min_samples: int, axes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, component) of the points in clusters: the least id of a core point of the point's cluster.

    A core point has min_samples points within eps, itself included. A border point takes the least of the clusters that have a core
    point within eps. Points without a coordinate are in none. At a radius of zero only points at the same place are neighbours, and
    a negative one holds none.
    """
    if eps <= 0:
        own = points.where(F.lit(eps == 0)).select(*keys, "id", *[F.col(a).cast("double").alias(a) for a in axes]).dropna(subset=list(axes))
        places = checkpointed(own.groupBy(*keys, *axes).agg(F.min("id").alias("component"), F.count("*").alias("n")))
        full = places.where(F.col("n") >= min_samples)
        return looked_up(own, [*keys, *axes], full.drop("n"), hot_rows(full), ["id"]).where("component is not null").select(*keys, "id", "component")
    grid = CellGrid(points, eps, axes, keys)
    row = [*grid.keys, "id"]
    sparse = grid.points.where(F.col("n") < min_samples)
    # For each sparse point and cell around it, how many of the cell's points are within eps; added up map-side.
    near = checkpointed(grid.within(sparse).groupBy(*grid.keys, F.col("a_id").alias("id"), *grid.places).agg(F.count("*").alias("within"), F.first("n").alias("n")))
    counted = near.groupBy(*row).agg(F.sum("within").alias("all"))
    some = sparse.drop("n").join(counted.where(F.col("all") >= min_samples).select(*row), row, "left_semi")
    core = grid.points.where(F.col("n") >= min_samples).drop("n").unionByName(some)
    cells = checkpointed(core.groupBy(*grid.cell).agg(F.min(F.struct(*row)).alias("rep"), F.count("*").alias("n")))
    core = checkpointed(looked_up(core, grid.cell, cells.drop("n"), hot_rows(cells), ["id"]))
    links = links_of_cells(core.select("rep", "id", *grid.axes), cells.drop("n"), grid)
    parts = connected_components(cells.select(F.col("rep").alias("id")), links)
    named = checkpointed(cells.join(parts.select(F.col("id").alias("rep"), F.col("component.id").alias("component")), "rep").select(*grid.cell, "component", "n"))
    inside = looked_up(core, grid.cell, named.drop("n"), hot_rows(named), ["id"]).select(*row, "component")
    # Border points: any point of a dense cell is a core point; of other cells the few core points are compared.
    loose = near.join(counted.where(F.col("all") < min_samples).select(*row), row, "left_semi")
    touching = loose.where(F.col("n") >= min_samples).join(named.drop("n"), grid.cell).select(*row, "component")
    others = loose.where(F.col("n") < min_samples).join(sparse.select(*row, *[F.col(a).alias(f"a_{a}") for a in grid.axes]), row)
    few = core.select(*grid.cell, *[F.col(a).alias(f"b_{a}") for a in grid.axes])
    met = others.join(few, grid.cell).where(squared_distance("a", "b", grid.axes) <= grid.eps * grid.eps).join(named.drop("n"), grid.cell).select(*row, "component")
    border = touching.union(met).groupBy(*row).agg(F.min("component").alias("component"))
    return inside.union(border)


def numbered_clusters(clusters: DataFrame, keys: Sequence[str], first: int = 0) -> DataFrame:
    """clusters with cluster_label: the place of the component among those of its keys."""
    each = ranked(clusters.select(*keys, "component").distinct(), *keys, "component", rank="__all")
    if not keys:
        named = each.select("component", (F.col("__all") - 1 + first).cast("int").alias("cluster_label"))
    else:
        least = each.groupBy(*keys).agg(F.min("__all").alias("__least"))
        named = each.join(least, list(keys)).select(*keys, "component", (F.col("__all") - F.col("__least") + first).cast("int").alias("cluster_label"))
    sizes = clusters.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    return looked_up(clusters, [*keys, "component"], named, hot_rows(sizes), ["id"]).drop("component")
