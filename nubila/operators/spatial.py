"""Spatial range joins, ring counts and nearest neighbours by bucketed equi-joins.

Space is cut into cubes with the join's radius as edge. One side is copied to the neighbouring cubes, so a plain equi-join on the
cube finds all pairs, each once; exact distances are then compared. The left rows of a dense cube are dealt into parts, and the
right rows sent to each part, so no task holds a dense cube. Ring counts make no pairs: arrays of a cube's points are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed, squared_distance, steps_array

#: Left rows of one cube that are a join key of their own.
PART = 20_000


def _side(df: DataFrame, name: str, axes: Sequence[str], edge: float, keys: Sequence[str], spread: bool, more: Sequence[str] = ()) -> DataFrame:
    columns = [F.col("id").alias(f"{name}_id"), *[F.col(a).cast("double").alias(f"{name}_{a}") for a in axes], *[F.col(c).alias(f"{name}_{c}") for c in more]]
    out = df.select(*keys, *columns)
    for a in axes:
        out = out.withColumn(f"__{a}", F.floor(F.col(f"{name}_{a}") / edge))
    if spread:
        steps = steps_array(list(itertools.product((-1, 0, 1), repeat=len(axes))), axes)
        out = out.withColumn("__step", F.explode(steps)).withColumns({f"__{a}": F.col(f"__{a}") + F.col(f"__step.{a}") for a in axes}).drop("__step")
    return out


def box_join(left: DataFrame, right: DataFrame, reach: float, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """Pairs whose coordinates differ by at most reach on each axis: keys, a_id, b_id, d2, and a_, b_ of more."""
    a, b = _side(left, "a", axes, reach, keys, False, more), _side(right, "b", axes, reach, keys, True, more)
    near = F.lit(True)
    for x in axes:
        near = near & (F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) <= reach)
    cube = [*keys, *[f"__{x}" for x in axes]]
    dense = a.groupBy(*cube).agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts")).where("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1))
    a = a.join(dense, cube, "left").withColumn("__part", F.pmod(F.xxhash64("a_id"), parts).cast("int")).drop("__parts")
    b = b.join(dense, cube, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    pairs = a.join(b, [*cube, "__part"]).where(near)
    return pairs.select(*keys, "a_id", "b_id", squared_distance("a", "b", axes).alias("d2"), *[f"{s}_{c}" for c in more for s in "ab"])


def range_join(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """Pairs at distance at most radius: keys, a_id, b_id, d2. Joined with itself a table pairs each point with itself too."""
    return box_join(left, right, radius, axes, keys, more).where(F.col("d2") <= radius * radius)


#: Stretches that a line is cut into at most, and rows of one that are a key of their own.
STRETCHES, ROWS = 1000, 200_000


def _counts_on_line(values: np.ndarray, others: np.ndarray, times: np.ndarray, reach: float) -> np.ndarray:
    """How many others, each so many times, have |value - other| <= reach. Both differences are monotone, rounded too: two bisections."""
    order = np.argsort(others)
    others, upto = others[order], np.concatenate([[0], np.cumsum(times[order])])

    def first(beyond) -> np.ndarray:
        low, high = np.zeros(len(values), dtype=np.int64), np.full(len(values), len(others), dtype=np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            right = beyond(others[np.minimum(middle, len(others) - 1)])
            high, low = np.where(open_ & right, middle, high), np.where(open_ & ~right, middle + 1, low)
        return low

    return upto[first(lambda b: b - values > reach)] - upto[first(lambda b: values - b <= reach)]


def line_counts(left: DataFrame, right: DataFrame, reach: float, axis: str) -> DataFrame:
    """id and n: the right rows within reach of each left row along one axis; left rows that have none are left out.

    No pairs are made: equal right values are one with their number, and the rows of a stretch of the line are counted by bisection, so
    the work grows with the rows. Stretches with many rows are dealt into parts on both sides.
    """
    a = left.select("id", F.col(axis).cast("double").alias("v")).dropna(subset=["v"])
    b = right.select(F.col(axis).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("times"))
    span = a.agg((F.max("v") - F.min("v")).alias("span")).first()["span"] or 0.0
    edge = max(reach, span / STRETCHES, 1e-9)
    near = reach * (1 + 1e-9)
    a = a.withColumn("cell", F.floor(F.col("v") / edge))
    b = b.withColumn("cell", F.explode(F.sequence(F.floor((F.col("v") - near) / edge), F.floor((F.col("v") + near) / edge))))
    many = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias(name))
    parts = many(a, "__a").join(many(b, "__b"), "cell")
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    a = a.join(parts, "cell").withColumn("a_part", F.pmod(F.xxhash64("id"), F.col("__a")).cast("int")).withColumn("b_part", all_of("__b"))
    b = b.join(parts, "cell").withColumn("b_part", F.pmod(F.xxhash64("v"), F.col("__b")).cast("int")).withColumn("a_part", all_of("__a"))

    def counted(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = _counts_on_line(rows["v"].to_numpy(), others["v"].to_numpy(), others["times"].to_numpy(), reach) if len(others) else np.zeros(len(rows), dtype=np.int64)
        return pd.DataFrame({"id": rows["id"], "n": found})

    key = ["cell", "a_part", "b_part"]
    kind = dict(a.dtypes)["id"]
    each = a.select(*key, "id", "v").groupBy(*key).cogroup(b.select(*key, "v", "times").groupBy(*key)).applyInPandas(counted, f"id {kind}, n long")
    return each.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")


#: Left and right rows of a cube that meet in one call, rows of a block and pairs whose distances are held at once, rows of a task.
CROWD, OTHERS, BLOCK, HELD, TASK = 5_000, 500_000, 32, 65_536, 1_000_000


def _greatest_square(ring: int, step: float) -> float:
    """The greatest d2 with ceil(sqrt(d2) / step) <= ring, rounded as that is."""
    within = lambda d2: np.ceil(np.sqrt(d2) / step) <= ring
    d2 = np.float64(ring * step) ** 2
    while within(np.nextafter(d2, np.inf)):
        d2 = np.nextafter(d2, np.inf)
    while not within(d2):
        d2 = np.nextafter(d2, 0.0)
    return float(d2)


def _near_blocks(points: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of points (axes x rows) in blocks of BLOCK at most that lie close together: halved along the widest axis."""
    waiting = [np.arange(points.shape[1])] if points.shape[1] else []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= BLOCK:
            yield rows
            continue
        own = points[:, rows]
        order = np.argpartition(own[np.argmax(own.max(axis=1) - own.min(axis=1))], len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _counts_within(points: np.ndarray, others: np.ndarray, limits: Sequence[float]) -> np.ndarray:
    """How many others (axes x rows) have a squared distance of at most each limit, the last being the greatest, to each point.

    Only others within reach of a block's box meet its points; that gap is rounded like the distances, so it never exceeds one.
    """
    out = np.zeros((points.shape[1], len(limits)), dtype=np.int64)
    for rows in _near_blocks(points):
        own = points[:, rows]
        gap = sum((np.maximum(np.maximum(lo - v, v - hi), 0.0) ** 2 for lo, hi, v in zip(own.min(axis=1), own.max(axis=1), others, strict=True)), 0.0)
        near = others[:, gap <= limits[-1]]
        for m in range(0, near.shape[1], HELD // BLOCK):
            d2 = 0.0
            for u, v in zip(own, near[:, m : m + HELD // BLOCK], strict=True):
                apart = u[:, None] - v[None, :]
                d2 = d2 + np.multiply(apart, apart, out=apart)
            for ring, limit in enumerate(limits):
                out[rows, ring] += [np.count_nonzero(one) for one in d2 <= limit]
    return out


def ring_counts(left: DataFrame, right: DataFrame, radius: float, step: float = 10.0, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), same: bool = False) -> DataFrame:
    """For each left id and ring (k: distance in ((k-1) step, k step], zero in the first): in_ring and cumulative within.

    Rings without neighbours have zeros. same leaves out the point itself. Pairs are counted as arrays inside tasks and never become
    rows: right rows go to the cubes they reach, of twice the radius as edge; left rows of a crowded cube are dealt into parts of
    CROWD, its right ones into parts of OTHERS.
    """
    last, edge, reach, cube = int(radius // step), 2.0 * radius, radius * (1 + 1e-9), [*keys, *[f"__{x}" for x in axes]]

    def placed(df: DataFrame, name: str) -> DataFrame:
        """Rows that can have neighbours; nulls in a join key meet nothing, and no distance is finite but between finite places."""
        known = [F.col(c).isNotNull() for c in keys] + [F.col("id").isNotNull()] * (name == "a" or same)
        out = df.select(*keys, F.col("id").alias(f"{name}_id"), *[F.col(x).cast("double").alias(f"{name}_{x}") for x in axes], reduce(and_, known, F.lit(True)).alias("__known"))
        return out.where("__known").drop("__known").where(reduce(and_, [F.abs(F.col(f"{name}_{x}")) < float("inf") for x in axes]))

    a, b = placed(left, "a"), placed(right, "b")
    for x in axes:
        a = a.withColumn(f"__{x}", F.floor(F.col(f"a_{x}") / edge))
        b = b.withColumn(f"__{x}", F.explode(F.sequence(F.floor((F.col(f"b_{x}") - reach) / edge), F.floor((F.col(f"b_{x}") + reach) / edge))))
    rows = lambda df, name: df.groupBy(*cube).agg(F.count("*").alias(name))
    cubes = rows(a, "__p").join(rows(b, "__q"), cube).withColumns({"__m": F.ceil(F.col("__p") / CROWD).cast("int"), "__n": F.ceil(F.col("__q") / OTHERS).cast("int")})
    both = checkpointed(cubes)
    sent = both.agg(F.sum(F.col("__p") * F.col("__n") + F.col("__q") * F.col("__m")).alias("rows"), F.sum(F.col("__m") * F.col("__n")).alias("calls")).first()
    # Work isn't told by bytes, so tasks are not merged by their size.
    tasks = max(1, min(sent["calls"] or 0, max(4 * left.sparkSession.sparkContext.defaultParallelism, (sent["rows"] or 0) // TASK)))
    both = both.drop("__p", "__q")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda side, name: F.pmod(F.xxhash64(*[f"{side}_{c}" for c in ("id", *axes)]), F.col(name)).cast("int")
    a = a.join(both, cube).withColumn("__i", own("a", "__m")).withColumn("__j", each("__n"))
    b = b.join(both, cube).withColumn("__j", own("b", "__n")).withColumn("__i", each("__m"))
    limits = [min(_greatest_square(k, step), radius * radius) for k in range(1, last)] + [radius * radius]

    def counted(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.array([df[f"{s}_{x}"].to_numpy() for x in axes]) for df, s in ((rows, "a"), (others, "b")))
        out = _counts_within(p, q, limits)
        if same:
            ids = [pd.DataFrame({"id": df[f"{s}_id"], f"__{s}": np.arange(len(df))}) for df, s in ((rows, "a"), (others, "b"))]
            one = ids[0].merge(ids[1], on="id")
            i, j = one["__a"].to_numpy(), one["__b"].to_numpy()
            d2 = sum(((u[i] - v[j]) ** 2 for u, v in zip(p, q, strict=True)), 0.0)
            for ring, limit in enumerate(limits):
                np.subtract.at(out[:, ring], i, (d2 <= limit).astype(np.int64))
        return pd.DataFrame({**{k: rows[f"a__{k}"] for k in keys}, "id": rows["a_id"], "counts": list(out)})

    call, kinds = [*cube, "__i", "__j"], dict(a.dtypes)
    kind = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"id {kinds['a_id']}", "counts array<long>"])

    def dealt(df: DataFrame, name: str, more: Sequence[str]) -> GroupedData:
        """Grouped by columns of their own, since both sides were joined with the same table."""
        mine = {c: f"{name}__{c}" for c in call}
        return df.select(*[F.col(c).alias(m) for c, m in mine.items()], *more, *[f"{name}_{x}" for x in axes]).repartition(tasks, *mine.values()).groupBy(*mine.values())

    found = dealt(a, "a", ["a_id"]).cogroup(dealt(b, "b", ["b_id"] if same else [])).applyInPandas(counted, kind)
    # A point has one row for each part of the right rows.
    sums = found.groupBy(*keys, "id").agg(*[F.sum(F.col("counts")[k]).alias(f"__r{k}") for k in range(last)])
    known = left.select(*keys, "id").join(sums, [*keys, "id"], "left").select(*keys, "id", F.array(*[F.coalesce(f"__r{k}", F.lit(0).cast("long")) for k in range(last)]).alias("__all"))
    rings = known.select(*keys, "id", "__all", F.posexplode("__all").alias("__k", "within"))
    return rings.select(*keys, "id", (F.col("__k") + 1).alias("ring"), (F.col("within") - F.coalesce(F.get("__all", F.col("__k") - 1), F.lit(0))).alias("in_ring"), "within")


#: The name of the form without keys.
crowded_ring_counts = ring_counts


def most_pairs(points: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z")) -> int:
    """How many pairs a range join of points with themselves compares: a bound of its rows, from counts of cubes."""
    cells = [f"__{a}" for a in axes]
    counts = checkpointed(points.dropna(subset=list(axes)).groupBy(*[F.floor(F.col(a) / radius).alias(c) for a, c in zip(axes, cells, strict=True)]).agg(F.count("*").alias("n")))
    steps = steps_array(list(itertools.product((-1, 0, 1), repeat=len(axes))), axes)
    moved = counts.withColumnRenamed("n", "m").withColumn("__step", F.explode(steps)).withColumns({f"__{a}": F.col(f"__{a}") + F.col(f"__step.{a}") for a in axes})
    return moved.join(counts, cells).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0


#: Halvings of the box that counts are taken at.
LEVELS = 14


def _pyramid(points: DataFrame, name: str, reach: float, axes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, id, coordinates and the finest cell of each point; coarser cells are this one's shifted right."""
    out = points.select(*keys, F.col("id").alias(f"{name}_id"), *[F.col(a).cast("double").alias(f"{name}_{a}") for a in axes]).dropna(subset=[f"{name}_{a}" for a in axes])
    return out.withColumns({f"__{a}": F.floor(F.col(f"{name}_{a}") / reach * 2.0 ** (LEVELS - 1)).cast("long") for a in axes})


def _at_level(level: Column, axes: Sequence[str]) -> dict[str, Column]:
    return {f"__{a}": F.floor(F.col(f"__{a}") / F.pow(F.lit(2.0), LEVELS - 1 - level)).cast("long") for a in axes}


def search_radii(left: DataFrame, counts: DataFrame, k: int, reach: float, axes: Sequence[str], keys: Sequence[str], square: bool = True) -> DataFrame:
    """left (finest cells) with level and r: a radius that holds the k nearest, and the level of the cells to search.

    counts: n right points of each cell at each level. A cell with k points or more lies within its diagonal around each of its
    points; one level finer, the nearest of the 27 cells around that hold k points together give a smaller radius. Points of whose
    cells none holds k keep the whole box: their r is null. square: distances are Euclidean; else the greatest axis counts.
    """
    places, d = [f"__{a}" for a in axes], len(axes)
    finest = left.select(*keys, *places).distinct()
    up = finest.withColumns({f"__fine{i}": F.col(c) for i, c in enumerate(places)}).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    full = counts.where(F.col("n") >= k).select(*keys, "level", *places)
    fine = [f"__fine{i}" for i in range(d)]
    deepest = up.withColumns(_at_level(F.col("level"), axes)).join(full, [*keys, "level", *places]).groupBy(*keys, *fine).agg(F.max("level").alias("level"))
    known = checkpointed(deepest.withColumnsRenamed(dict(zip(fine, places, strict=True))))
    # The cells around, one level finer, by the axes along which they are others.
    cells = known.where(F.col("level") < LEVELS - 1).select(*keys, (F.col("level") + 1).alias("level"), *places).withColumns(_at_level(F.col("level"), axes)).distinct()
    steps = steps_array([(*s, sum(map(abs, s))) for s in itertools.product((-1, 0, 1), repeat=d)], [*axes, "others"])
    moved = cells.withColumns({f"__own{i}": F.col(c) for i, c in enumerate(places)}).withColumn("step", F.explode(steps)).withColumns({f"__{a}": F.col(f"__{a}") + F.col(f"step.{a}") for a in axes})
    around = moved.join(counts, [*keys, "level", *places])
    own = [f"__own{i}" for i in range(d)]
    held = around.groupBy(*keys, "level", *own).agg(*[F.coalesce(F.sum(F.when(F.col("step.others") <= z, F.col("n"))), F.lit(0)).alias(f"n{z}") for z in range(d + 1)])
    far = F.lit(None).cast("double")
    for z in reversed(range(d + 1)):
        far = F.when(F.col(f"n{z}") >= k, F.lit((4 * z + d - z) ** 0.5 if square else 2.0 if z else 1.0)).otherwise(far)
    tight = held.select(*keys, (F.col("level") - 1).alias("level"), *[F.col(o).alias(c) for o, c in zip(own, places, strict=True)], (far * F.lit(reach) / F.pow(F.lit(2.0), F.col("level"))).alias("tight"))
    named = known.withColumns({f"__own{i}": v for i, v in enumerate(_at_level(F.least(F.col("level") + 1, F.lit(LEVELS - 1)), axes).values())})
    named = named.join(tight.withColumnsRenamed(dict(zip(places, own, strict=True))), [*keys, "level", *own], "left")
    wide = F.lit(reach * (d**0.5 if square else 1.0)) / F.pow(F.lit(2.0), F.col("level"))
    radii = named.select(*keys, *places, "level", (F.coalesce("tight", wide) * (1 + 1e-9)).alias("r"))
    return left.join(radii, [*keys, *places], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def nearest(left: DataFrame, right: DataFrame, k: int, reach: float, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), square: bool = True) -> DataFrame:
    """The k nearest right points in the box of reach around each left point: a_id, b_id, d2, rank; ties by id.

    Counts of points in cells of halving size give each left point a radius that holds its k nearest, so only cells it touches are
    searched, at a level where they hold few points. square: by Euclidean distance; else by the greatest axis, whose square is d2.
    Points without a coordinate have no neighbours and are none.
    """
    places, edge = [f"__{a}" for a in axes], F.lit(reach) / F.pow(F.lit(2.0), F.col("level"))
    a, b = _pyramid(left, "a", reach, axes, keys), _pyramid(right, "b", reach, axes, keys)
    at_all = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    counts = checkpointed(b.select(*keys, *places, at_all.alias("level")).withColumns(_at_level(F.col("level"), axes)).groupBy(*keys, "level", *places).agg(F.count("*").alias("n")))
    a = search_radii(a, counts, k, reach, axes, keys, square).withColumns(_at_level(F.col("level"), axes))
    steps = steps_array(list(itertools.product(range(-2, 3), repeat=len(axes))), axes)
    touched = a.withColumn("step", F.explode(steps)).withColumns({f"__{x}": F.col(f"__{x}") + F.col(f"step.{x}") for x in axes}).drop("step")
    gap = {x: F.greatest(F.col(f"__{x}") * edge - F.col(f"a_{x}"), F.col(f"a_{x}") - (F.col(f"__{x}") + 1) * edge, F.lit(0.0)) * (1 - 1e-9) for x in axes}
    reached = F.greatest(*gap.values()) <= F.least(F.coalesce("r", F.lit(reach)), F.lit(reach)) if len(axes) > 1 else gap[axes[0]] <= F.least(F.coalesce("r", F.lit(reach)), F.lit(reach))
    if square:
        reached = reached & (F.col("r").isNull() | (sum((g * g for g in gap.values()), F.lit(0.0)) <= F.col("r") * F.col("r")))
    cube = [*keys, "level", *places]
    # A crowded cell's points are dealt into parts, and what searches it goes to each.
    met = touched.where(reached).join(counts, cube).withColumn("__part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1))).drop("n")
    crowded = counts.where(F.col("n") > PART).withColumnRenamed("n", "__n")
    dealt = b.withColumn("level", at_all).withColumns(_at_level(F.col("level"), axes)).join(crowded, cube, "left")
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("b_id"), F.coalesce(F.ceil(F.col("__n") / PART), F.lit(1))).cast("int")).drop("__n")
    pairs = met.join(dealt, [*cube, "__part"])
    for x in axes:
        pairs = pairs.where(F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) <= reach)
    apart = [F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) for x in axes]
    far = apart[0] if len(axes) == 1 else F.greatest(*apart)
    d2 = squared_distance("a", "b", axes) if square else far * far
    close = pairs.withColumn("d2", d2).where(F.col("r").isNull() | (F.col("d2") <= F.col("r") * F.col("r")))
    # The rank's limit is applied by every task before the shuffle.
    w = Window.partitionBy(*keys, "a_id").orderBy("d2", "b_id")
    return close.select(*keys, "a_id", "b_id", "d2").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_nearest(left: DataFrame, right: DataFrame, k: int = 10, reach: float = 1000.0, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), skip: int = 0) -> DataFrame:
    """Mean distance to the k nearest in the box, without the first skip: id, distance, found."""
    near = nearest(left, right, k, reach, axes, keys).where(F.col("rank") > skip)
    return near.groupBy(*keys, F.col("a_id").alias("id")).agg(F.avg(F.sqrt("d2")).alias("distance"), F.count("*").alias("found"))


def density_ratio(own: DataFrame, other: DataFrame, k: int = 10, reach: float = 1000.0, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = ()) -> DataFrame:
    """own with ratio: mean distance to the k nearest other points over that to the k nearest own ones, the point itself among them.

    Null where no other point is in the box of reach, or no own point but those at the same place.
    """
    near, far = mean_nearest(own, own, k, reach, axes, keys), mean_nearest(own, other, k, reach, axes, keys)
    both = near.select(*keys, "id", F.col("distance").alias("__near")).join(far.select(*keys, "id", F.col("distance").alias("__far")), [*keys, "id"], "left")
    ratio = F.when(F.col("__near") > 0, F.col("__far") / F.col("__near"))
    return own.join(both.select(*keys, "id", ratio.alias("ratio")), [*keys, "id"], "left")


def adaptive_mean_nearest(points: DataFrame, k: int = 11, least: int = 10, divisor: float = 70.0, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean distance to neighbours 2..k inside a box that is widened until it holds `least` points: id, distance.

    The box starts at the largest axis range over divisor and doubles. How far it has to reach follows from the distance, along the
    greatest axis, to the least-th nearest point, so each point is joined at its own reach only.
    """
    row = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes], F.count("*").alias("n")).first()
    if not row["n"]:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    span = max(max(float(row[a] or 0) for a in axes), 1e-9)
    reaches = [span / divisor]
    while reaches[-1] < span:
        reaches.append(reaches[-1] * 2)
    # One box of the last reach holds all points.
    last = nearest(points, points, min(least, row["n"]), reaches[-1], axes, square=False).groupBy("a_id").agg(F.max("d2").alias("d2"))
    step = F.lit(len(reaches) - 1)
    for i in reversed(range(len(reaches) - 1)):
        step = F.when(F.sqrt("d2") <= reaches[i], F.lit(i)).otherwise(step)
    placed = checkpointed(points.select("id", *axes).join(last.select(F.col("a_id").alias("id"), step.alias("step")), "id"))
    out = None
    for r in placed.select("step").distinct().orderBy("step").collect():
        near = nearest(placed.where(F.col("step") == r["step"]), points, k, reaches[r["step"]], axes)
        out = near if out is None else out.unionByName(near)
    return out.groupBy(F.col("a_id").alias("id")).agg(F.avg(F.when(F.col("rank") > 1, F.sqrt("d2"))).alias("distance"))


def paired_in_frames(events: DataFrame, frame: str, position: str, intensity: str | None = None, far: float = 500.0) -> DataFrame:
    """Distance of the two events of each frame that holds exactly two, and whether it exceeds far."""
    two = events.groupBy(frame).agg(F.count("*").alias("n")).where("n = 2").select(frame)
    kept = events.join(two, frame, "left_semi")
    value = intensity or position
    ends = kept.groupBy(frame).agg(F.min_by(position, "id").alias("p0"), F.max_by(position, "id").alias("p1"), F.min_by(value, "id").alias("i0"), F.max_by(value, "id").alias("i1"), F.min("id").alias("first_id"), F.max("id").alias("second_id"))
    return ends.select(frame, "first_id", "second_id", F.abs(F.col("p1") - F.col("p0")).alias("distance"), (F.col("i1") - F.col("i0")).alias("intensity_difference"), (F.abs(F.col("p1") - F.col("p0")) > far).alias("far"))
