"""Grids and raster morphology over sparse cells (ix, iy, value), all by DataFrame operations.

A mask is a table of the cells that are set. `shape` tables hold nx and ny for each key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed, grid_index, voxel_index
from nubila.operators.graph import connected_components

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def disk(radius: int) -> tuple[tuple[int, int], ...]:
    """Offsets within a Euclidean radius."""
    return tuple((i, j) for i, j in itertools.product(range(-radius, radius + 1), repeat=2) if i * i + j * j <= radius * radius)


def extent(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Lower corner and shape of each key's grid: x0, y0, nx, ny."""
    cells = lambda a: F.greatest(F.ceil((F.max(a) - F.min(a)) / size), F.lit(1)).cast("int")
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), cells("x").alias("nx"), cells("y").alias("ny"))


def _with(df: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(one, list(keys)) if keys else df.crossJoin(F.broadcast(one))


def on_grid(points: DataFrame, box: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """points with their cell ix, iy in the grid of box."""
    both = _with(points, box, keys)
    both = both.withColumn("ix", grid_index(F.col("x"), F.col("x0"), size, F.col("nx"))).withColumn("iy", grid_index(F.col("y"), F.col("y0"), size, F.col("ny")))
    return both.drop("x0", "y0", "nx", "ny")


def density_grid(points: DataFrame, size: float = 50.0, keys: Sequence[str] = (), box: DataFrame | None = None) -> DataFrame:
    """Localizations of each occupied cell: keys, ix, iy, value."""
    return on_grid(points, extent(points, size, keys) if box is None else box, size, keys).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("value"))


def voxel_counts(points: DataFrame, size: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """Localizations of each occupied voxel, one-based: keys, ix, iy, iz, value."""
    low = points.groupBy(*keys).agg(*[F.min(a).alias(f"{a}0") for a in "xyz"])
    both = _with(points, low, keys)
    return both.groupBy(*keys, *[voxel_index(F.col(a), F.col(f"{a}0"), size).alias(f"i{a}") for a in "xyz"]).agg(F.count("*").alias("value"))


def collapsed(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum projection along z."""
    return voxels.groupBy(*keys, "ix", "iy").agg(F.sum("value").alias("value"))


def heat_voxels(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Voxel value count + ratio of the point with the largest id, for points with a ratio column."""
    low = points.groupBy(*keys).agg(*[F.min(a).alias(f"{a}0") for a in "xyz"])
    both = _with(points, low, keys)
    cells = [voxel_index(F.col(a), F.col(f"{a}0"), size).alias(f"i{a}") for a in "xyz"]
    return both.groupBy(*keys, *cells).agg(F.count("*").alias("n"), F.max_by("ratio", "id").alias("last")).select(*keys, "ix", "iy", "iz", (F.col("n") + F.col("last")).alias("value"))


def dense(shape: DataFrame, keys: Sequence[str] = (), margin: int = 0) -> DataFrame:
    """All cells of the grids, with a margin around them."""
    span = lambda n: F.explode(F.sequence(F.lit(-margin), F.col(n) - 1 + margin))
    # The rows of cells go over all tasks before they are spread out.
    rows = shape.select(*keys, span("nx").alias("ix"), "ny").repartition(*keys, "ix")
    return rows.select(*keys, "ix", span("ny").alias("iy"))


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


#: Cells of a tile's edge.
TILE = 128


def tile_rows(cells: DataFrame, reach: int, shape: DataFrame, keys: Sequence[str] = (), tile: int | None = None) -> DataFrame:
    """Each cell in its tile (tx, ty) and in those around that it is within reach of, where the grid has them."""
    tile = tile or TILE
    at = lambda axis, n: F.explode(F.sequence(F.greatest(F.floor((F.col(axis) - reach) / tile), F.lit(0)), F.least(F.floor((F.col(axis) + reach) / tile), F.floor((F.col(n) - 1) / tile))))
    inside = _with(cells, shape.select(*keys, "nx", "ny"), keys).where("ix BETWEEN 0 AND nx - 1 AND iy BETWEEN 0 AND ny - 1")
    return inside.withColumn("tx", at("ix", "nx")).withColumn("ty", at("iy", "ny"))


def _tiles(shape: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """One row for each tile of the grids."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / tile)))
    rows = shape.select(*keys, "nx", "ny", span("nx").alias("tx")).repartition(*keys, "tx")
    return rows.select(*keys, "nx", "ny", "tx", span("ny").alias("ty"))


def _taps(start: int, n: int, size: int, kernel: Sequence[float], border: str) -> np.ndarray:
    """The matrix that smooths the cells from `start` on, of a line of n cells, out of these and the kernel's radius around them."""
    radius = len(kernel) // 2
    out = np.zeros((min(size, n - start), size + 2 * radius))
    for i in range(len(out)):
        for k, w in enumerate(kernel, start=-radius):
            at = start + i + k
            turn = at % (2 * n)
            folded = (turn if turn < n else 2 * n - 1 - turn) if border == "reflect" else min(max(at, 0), n - 1)
            out[i, folded - start + radius] += w
    return out


def gaussian(grid: DataFrame, shape: DataFrame, sigma: float = 4.0, radius: int | None = None, border: str = "reflect", keys: Sequence[str] = ()) -> DataFrame:
    """Smoothed values of all cells, by separable taps with folded borders ("reflect" or "replicate").

    Cells meet in tiles. Only those within the kernel's radius of a tile's edge are sent to the next one too, so the shuffle is that
    of the occupied cells and a margin, whatever the kernel; inside a tile both passes are products with a band matrix.
    """
    radius = int(4 * sigma + 0.5) if radius is None else radius
    tile, kernel, kinds = max(TILE, radius), gaussian_kernel(sigma, radius), dict(shape.dtypes)
    cells = tile_rows(grid.select(*keys, "ix", "iy", F.col("value").cast("double").alias("value")), radius, shape, keys, tile)
    every = _tiles(shape, keys, tile).select(*keys, "nx", "ny", "tx", "ty", F.lit(None).cast("int").alias("ix"), F.lit(None).cast("int").alias("iy"), F.lit(0.0).alias("value"))
    rows = cells.select(*keys, "nx", "ny", "tx", "ty", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), "value").union(every)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x0, y0, nx, ny = int(first["tx"]) * tile, int(first["ty"]) * tile, int(first["nx"]), int(first["ny"])
        known = pdf[pdf["ix"].notna()]
        values = np.zeros((tile + 2 * radius, tile + 2 * radius))
        np.add.at(values, (known["ix"].to_numpy(int) - x0 + radius, known["iy"].to_numpy(int) - y0 + radius), known["value"].to_numpy(float))
        out = _taps(x0, nx, tile, kernel, border) @ values @ _taps(y0, ny, tile, kernel, border).T
        ix, iy = np.indices(out.shape)
        done = pd.DataFrame({"ix": (ix + x0).ravel().astype("int32"), "iy": (iy + y0).ravel().astype("int32"), "value": out.ravel()})
        for k in keys:
            done.insert(0, k, first[k])
        return done[[*keys, "ix", "iy", "value"]]

    typed = "".join(f"{k} {kinds[k]}, " for k in keys)
    return rows.groupBy(*keys, "tx", "ty").applyInPandas(smooth, f"{typed}ix int, iy int, value double")


def threshold(grid: DataFrame, cut: float, keys: Sequence[str] = ()) -> DataFrame:
    """The mask of cells above the cut."""
    return grid.where(F.col("value") > cut).select(*keys, "ix", "iy")


def shifted(cells: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Each cell moved by each offset: keys, ix, iy, with the first place as fx, fy."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    moved = cells.select(*keys, F.col("ix").alias("fx"), F.col("iy").alias("fy"), steps.alias("s"))
    return moved.select(*keys, "fx", "fy", (F.col("fx") + F.col("s.i")).alias("ix"), (F.col("fy") + F.col("s.j")).alias("iy"))


def row_runs(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stretches of neighbouring cells of each row: keys, iy, lo, hi."""
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    cells = mask.select(*keys, "ix", "iy").distinct().withColumn("__run", F.col("ix") - F.row_number().over(w))
    return cells.groupBy(*keys, "iy", "__run").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi")).drop("__run")


def run_cells(runs: DataFrame, keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """The cells of runs: keys, ix, iy and more columns."""
    return runs.select(*keys, F.explode(F.sequence("lo", "hi")).alias("ix"), "iy", *more)


def gaps(runs: DataFrame, shape: DataFrame, keys: Sequence[str] = (), margin: int = 0) -> DataFrame:
    """The stretches of each row of the grids, with a margin around them, that the runs leave free."""
    rows = shape.select(*keys, "nx", F.explode(F.sequence(F.lit(-margin), F.col("ny") - 1 + margin)).alias("iy")).repartition(*keys, "iy")
    bounds = rows.join(runs, [*keys, "iy"], "left").withColumn("last", F.col("nx") - 1 + margin)
    w = Window.partitionBy(*keys, "iy").orderBy("lo")
    bounds = bounds.withColumns({"before": F.lag("hi").over(w), "behind": F.lead("lo").over(w)})
    free = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    first = free(F.coalesce(F.col("before") + 1, F.lit(-margin)), F.coalesce(F.col("lo") - 1, F.col("last")))
    last = F.when(F.col("lo").isNotNull() & F.col("behind").isNull(), free(F.col("hi") + 1, F.col("last")))
    parts = bounds.select(*keys, "iy", F.explode(F.array(first, last)).alias("g"))
    return parts.select(*keys, "iy", "g.lo", "g.hi").where("lo <= hi")


#: Columns of a bucket in which runs of neighbouring rows meet.
STRIP = 64


def run_components(runs: DataFrame, keys: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """runs with component: the smallest cell (keys, ix, iy) of the connected part.

    Runs are the vertices, so a wide area costs its rows and not its cells. Runs of neighbouring rows that overlap, or with diagonal
    touch at corners, are linked; they meet in strips of STRIP columns, so no row is one key.
    """
    slack = 1 if diagonal else 0
    cell = F.struct(*keys, F.col("lo").alias("ix"), "iy")
    own = checkpointed(runs.select(*keys, "iy", "lo", "hi", cell.alias("id")))
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(lo / STRIP), F.floor(hi / STRIP)))
    above = own.select(*keys, (F.col("iy") + 1).alias("iy"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("id").alias("a"), strips(F.col("lo") - slack, F.col("hi") + slack).alias("strip"))
    below = own.select(*keys, "iy", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("id").alias("b"), strips(F.col("lo"), F.col("hi")).alias("strip"))
    links = above.join(below, [*keys, "iy", "strip"]).where((F.col("a_lo") <= F.col("b_hi") + slack) & (F.col("b_lo") <= F.col("a_hi") + slack))
    parts = connected_components(own.select("id"), links.select("a", "b"))
    return own.join(parts, "id").select(*keys, "iy", "lo", "hi", "component")


def components(mask: DataFrame, neighbours: Sequence[tuple[int, int]] = FOUR, keys: Sequence[str] = ()) -> DataFrame:
    """mask with component: the smallest cell (as struct) of each connected part. neighbours: FOUR or EIGHT."""
    if set(neighbours) not in (set(FOUR), set(EIGHT)):
        raise ValueError("neighbours are four or eight")
    return run_cells(run_components(row_runs(mask, keys), keys, set(neighbours) == set(EIGHT)), keys, ["component"])


def component_sizes(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return parts.groupBy(*keys, "component").agg(F.count("*").alias("pixels"))


def largest(parts: DataFrame, count: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of the largest components; of equal ones that with the smallest cell."""
    sizes = component_sizes(parts, keys)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("pixels"), "component")
        kept = sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
    else:
        kept = sizes.orderBy(F.desc("pixels"), "component").limit(count)
    return parts.join(kept.select(*keys, "component"), [*keys, "component"], "left_semi").select(*keys, "ix", "iy")


def drop_small(parts: DataFrame, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of components with at least so many pixels."""
    kept = component_sizes(parts, keys).where(F.col("pixels") >= least).select(*keys, "component")
    return parts.join(kept, [*keys, "component"], "left_semi").select(*keys, "ix", "iy")


def fill_holes(mask: DataFrame, shape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The mask with the background parts that don't reach the border.

    The background is the gaps between the mask's runs, so what is labelled grows with the mask's outline and the rows.
    """
    inside = _with(mask.select(*keys, "ix", "iy"), shape, keys).where("ix BETWEEN -1 AND nx AND iy BETWEEN -1 AND ny").select(*keys, "ix", "iy")
    parts = run_components(gaps(row_runs(inside, keys), shape, keys, margin=1), keys)
    outer = parts.where("iy = -1 AND lo = -1").select(*keys, F.col("component").alias("outer"))
    outside = _with(parts, outer, keys).where("component = outer").select(*keys, "iy", "lo", "hi")
    return run_cells(gaps(outside, shape, keys, margin=1), keys)


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Cells all of whose offsets are in the mask."""
    hits = shifted(mask, offsets, keys).join(mask, [*keys, "ix", "iy"], "left_semi")
    return hits.groupBy(*keys, F.col("fx").alias("ix"), F.col("fy").alias("iy")).agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).drop("n")


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int]], within: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The mask grown by the offsets, inside another mask if given."""
    grown = shifted(mask, [*offsets, (0, 0)], keys).select(*keys, "ix", "iy").distinct()
    return grown if within is None else grown.join(within, [*keys, "ix", "iy"], "left_semi")


#: A ring that isn't known yet.
FAR = 1 << 30


def settle(ring: np.ndarray, free: np.ndarray, steps: Sequence[tuple[int, int]], reach: int) -> np.ndarray:
    """Rings of a tile with its margin of `reach`, when a free cell's is one more than the least of those a step away."""
    n, m = ring.shape[0] - 2 * reach, ring.shape[1] - 2 * reach
    ring, own = ring.copy(), free[reach : reach + n, reach : reach + m]
    while True:
        inner = ring[reach : reach + n, reach : reach + m]
        best = inner.copy()
        for i, j in steps:
            np.minimum(best, ring[reach + i : reach + i + n, reach + j : reach + j + m] + 1, out=best)
        best = np.where(own, best, inner)
        if (best == inner).all():
            return ring
        ring[reach : reach + n, reach : reach + m] = best


def _strip(d: int, tile: int, reach: int) -> slice:
    """The cells of a tile, by place in its array with margin, that lie in the margin of the tile d away."""
    return slice(reach, 2 * reach) if d < 0 else slice(tile, tile + reach) if d > 0 else slice(reach, reach + tile)


def _margin(d: int, tile: int, reach: int) -> slice:
    """Where the strip that comes from the tile d away goes."""
    return slice(0, reach) if d < 0 else slice(tile + reach, tile + 2 * reach) if d > 0 else slice(reach, reach + tile)


def wave_rings(cells: DataFrame, steps: Sequence[tuple[int, int]], outside: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ix, iy and ring of the free cells that a wave reaches, which goes one step a ring.

    cells: keys, ix, iy, free; those that aren't free have ring 0, and cells that aren't there have `outside` (0 or FAR). Every tile
    settles its own cells and sends strips as wide as a step to the tiles around when they changed, so the rounds are the tiles that
    the wave has to cross one after the other, however many rings it has.
    """
    tile, reach, kinds = TILE, max(max(abs(i), abs(j)) for i, j in steps), dict(cells.dtypes)
    if reach > tile:
        raise ValueError("a step is at most a tile")
    size, row = tile + 2 * reach, [*keys, "tx", "ty"]
    typed = "".join(f"{k} {kinds[k]}, " for k in keys)
    state = f"{typed}tx long, ty long, ring binary, free binary, moved array<int>"
    around = [(i, j) for i, j in EIGHT]
    near = lambda a: F.explode(F.sequence(F.floor((F.col(a) - reach) / tile), F.floor((F.col(a) + reach) / tile)))
    spread = cells.select(*keys, "ix", "iy", "free").withColumn("tx", near("ix")).withColumn("ty", near("iy"))

    def held(values: bytes, kind: str) -> np.ndarray:
        return np.frombuffer(values, kind).reshape(size, size)

    def told(first, ring: np.ndarray, free: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        """A row of the state; moved: the neighbours, by their place in `around`, whose margin changed."""
        moved = [k for k, (i, j) in enumerate(around) if (ring[_strip(i, tile, reach), _strip(j, tile, reach)] != before[_strip(i, tile, reach), _strip(j, tile, reach)]).any()]
        return pd.DataFrame([{**{k: first[k] for k in row}, "ring": ring.tobytes(), "free": free.tobytes(), "moved": moved}])

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x, y = pdf["ix"].to_numpy(int) - int(first["tx"]) * tile + reach, pdf["iy"].to_numpy(int) - int(first["ty"]) * tile + reach
        if not ((x >= reach) & (x < reach + tile) & (y >= reach) & (y < reach + tile)).any():
            return pd.DataFrame(columns=[*row, "ring", "free", "moved"])
        ring, free = np.full((size, size), outside, np.int32), np.zeros((size, size), np.uint8)
        mine = pdf["free"].to_numpy(bool)
        ring[x, y], free[x, y] = np.where(mine, FAR, 0), mine
        return told(first, settle(ring, free, steps, reach), free, ring)

    def send(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                ring = held(r["ring"], "<i4")
                for k in r["moved"]:
                    i, j = around[k]
                    out.append({**{c: r[c] for c in keys}, "tx": r["tx"] + i, "ty": r["ty"] + j, "i": -i, "j": -j, "strip": ring[_strip(i, tile, reach), _strip(j, tile, reach)].tobytes()})
            yield pd.DataFrame(out, columns=[*row, "i", "j", "strip"])

    def receive(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=[*row, "ring", "free", "moved"])
        first = own.iloc[0]
        before, free = held(first["ring"], "<i4"), held(first["free"], "u1")
        ring = before.copy()
        for r in sent.itertuples():
            place = _margin(r.i, tile, reach), _margin(r.j, tile, reach)
            ring[place] = np.minimum(ring[place], np.frombuffer(r.strip, "<i4").reshape(ring[place].shape))
        return told(first, settle(ring, free, steps, reach) if len(sent) else ring, free, before)

    def opened(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                ring, free = held(r["ring"], "<i4"), held(r["free"], "u1")
                inner = (slice(reach, reach + tile),) * 2
                x, y = np.nonzero((ring[inner] < FAR) & (free[inner] > 0))
                out = pd.DataFrame({"ix": (x + r["tx"] * tile).astype("int32"), "iy": (y + r["ty"] * tile).astype("int32"), "ring": ring[inner][x, y]})
                for k in reversed(keys):
                    out.insert(0, k, r[k])
                yield out

    tiles = checkpointed(spread.groupBy(*row).applyInPandas(begin, state))
    while not (moved := tiles.where(F.size("moved") > 0)).isEmpty():
        strips = moved.mapInPandas(send, f"{typed}tx long, ty long, i int, j int, strip binary")
        tiles = checkpointed(tiles.groupBy(*row).cogroup(strips.groupBy(*row)).applyInPandas(receive, state))
    return tiles.mapInPandas(opened, f"{typed}ix int, iy int, ring int")


def peel(mask: DataFrame, offsets: Sequence[tuple[int, int]] = disk(5), keys: Sequence[str] = (), inward: bool = True, within: DataFrame | None = None) -> DataFrame:
    """Ring of each cell: the erosion that removes it (inward), or the dilation inside `within` that adds it."""
    cell = [*keys, "ix", "iy"]
    if inward:
        return wave_rings(mask.select(*cell, F.lit(True).alias("free")), offsets, 0, keys)
    seeds = mask.select(*cell, F.lit(False).alias("free"))
    around = mask if within is None else within
    rest = around.select(*cell).join(mask, cell, "left_anti").withColumn("free", F.lit(True))
    return wave_rings(seeds.unionByName(rest), [(-i, -j) for i, j in offsets], FAR, keys)


def lower_envelope(heights: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of heights[k] + (at - places[k])^2 at each of the sorted places `at`, in linear time; places are sorted."""
    kept, begins = [0], [-math.inf]
    for k in range(1, len(places)):
        while True:
            j = kept[-1]
            cross = (heights[k] + places[k] ** 2 - heights[j] - places[j] ** 2) / (2 * (places[k] - places[j]))
            if cross > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(k)
        begins.append(cross)
    best = np.array(kept)[np.searchsorted(np.array(begins), at, side="right") - 1]
    return heights[best] + (at - places[best]) ** 2


def distance_map(mask: DataFrame, shape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Euclidean distance of each mask cell to the nearest background cell of the grid, null where there is none.

    Exact and linear in the grid: the nearest background along x by window, then for each column of cells, which is as long as the
    grid is high, the lower envelope of the parabolas that these distances open along y.
    """
    cells = dense(shape, keys).join(mask.withColumn("set", F.lit(1)), [*keys, "ix", "iy"], "left")
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    empty = F.when(F.col("set").isNull(), F.col("ix"))
    before = F.last(empty, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(empty, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = cells.select(*keys, "ix", "iy", "set", F.least(F.col("ix") - before, after - F.col("ix")).cast("double").alias("g"))
    kinds = dict(near.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in (*keys, "ix", "iy")], "distance double"])

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iy")
        known, mine = pdf["g"].notna().to_numpy(), pdf["set"].notna().to_numpy()
        out = pdf.loc[mine, [*keys, "ix", "iy"]].copy()
        y = pdf["iy"].to_numpy(float)
        out["distance"] = np.sqrt(lower_envelope(pdf["g"].to_numpy(float)[known] ** 2, y[known], y[mine])) if known.any() else np.nan
        return out

    found = near.groupBy(*keys, "ix").applyInPandas(column, schema)
    return found.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


def radial_bands(distances: DataFrame, bands: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Band of each mask cell by equal steps of distance, 0 innermost."""
    top = distances.groupBy(*keys).agg(F.max("distance").alias("top"))
    digit = F.least(F.greatest(F.floor(F.col("distance") * bands / F.col("top")) + 1, F.lit(1)), F.lit(bands))
    return _with(distances, top, keys).select(*keys, "ix", "iy", (bands - digit).cast("int").alias("band"))


def band_profile(points_on_grid: DataFrame, bands: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Localizations per pixel of each band: keys, band, points, pixels, density."""
    pixels = bands.groupBy(*keys, "band").agg(F.count("*").alias("pixels"))
    points = points_on_grid.join(bands, [*keys, "ix", "iy"]).groupBy(*keys, "band").agg(F.count("*").alias("points"))
    return pixels.join(points, [*keys, "band"], "left").select(*keys, "band", F.coalesce("points", F.lit(0)).alias("points"), "pixels", (F.coalesce("points", F.lit(0)) / F.col("pixels")).alias("density"))


def probability_map(distances: DataFrame, profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The profile's value (step from 0) at each cell's unit-distance shell; beyond the last step the last."""
    last = profile.groupBy(*keys).agg(F.max("step").alias("last"))
    shell = _with(distances, last, keys).withColumn("step", F.least(F.greatest(F.floor("distance") - 1, F.lit(0)), F.col("last")).cast("int"))
    return shell.join(profile.select(*keys, "step", "value"), [*keys, "step"]).select(*keys, "ix", "iy", F.col("value").alias("probability"))


def outline(vertices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of a closed polygon given as ordered integer vertices (order, ix, iy), by integer steps along each edge."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    nxt = lambda c: F.coalesce(F.lead(c).over(w.orderBy("order")), F.first(c).over(w.orderBy("order")))
    edges = vertices.select(*keys, "ix", "iy", nxt("ix").alias("jx"), nxt("iy").alias("jy"))
    steps = F.greatest(F.abs(F.col("jx") - F.col("ix")), F.abs(F.col("jy") - F.col("iy")), F.lit(1))
    along = edges.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")).cast("int")
    return along.select(*keys, at("ix", "jx").alias("ix"), at("iy", "jy").alias("iy")).distinct()


def ring_statistics(rings: DataFrame, points: DataFrame, px: float, least: int = 85, keys: Sequence[str] = ()) -> DataFrame:
    """Per ring: counts of both channels, area, ratio and densities, for rings with more than `least` of the first channel.

    points: keys, ix, iy, channel ("C1" or "C2").
    """
    area = rings.groupBy(*keys, "ring").agg((F.count("*") * (px / 1000) ** 2).alias("area"))
    n = lambda c: F.count(F.when(F.col("channel") == c, 1))
    counts = points.join(rings, [*keys, "ix", "iy"]).groupBy(*keys, "ring").agg(n("C1").alias("n1"), n("C2").alias("n2"))
    joined = area.join(counts, [*keys, "ring"]).where(F.col("n1") > least)
    return joined.select(*keys, "ring", "n1", "n2", "area", (F.col("n2") / F.col("n1")).alias("ratio"), (F.col("n1") / F.col("area")).alias("density1"), (F.col("n2") / F.col("area")).alias("density2"))


def filled_outline(vertices: DataFrame, shape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of a closed polygon and all that it encloses."""
    return fill_holes(outline(vertices, keys), shape, keys)


def projected_area(voxels: DataFrame, px: float, keys: Sequence[str] = ()) -> DataFrame:
    """Area, in square micrometres, of the cells (ix, iy) that any slice of a mask of voxels has."""
    return voxels.select(*keys, "ix", "iy").distinct().groupBy(*keys).agg((F.count("*") * (px / 1000) ** 2).alias("area"))


def two_step_mask(grid: DataFrame, shape: DataFrame, cut: float, within: DataFrame | None = None, keys: Sequence[str] = (), sigmas: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """Values smoothed, cut to a mask (inside another one if given) and the mask smoothed again, with replicated borders.

    Kernels reach two sigmas to each side, rounded up: five and nine cells.
    """
    first = gaussian(grid, shape, sigmas[0], math.ceil(2 * sigmas[0]), "replicate", keys)
    mask = threshold(first, cut, keys)
    mask = mask if within is None else mask.join(within, [*keys, "ix", "iy"], "left_semi")
    return gaussian(mask.withColumn("value", F.lit(1.0)), shape, sigmas[1], math.ceil(2 * sigmas[1]), "replicate", keys)


def weighted_rings(inner: DataFrame, profile: DataFrame, outer: DataFrame | None = None, outer_profile: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Density and ratio of each cell, from rings (ix, iy, ring) and profiles (ring, density, ratio): keys, ix, iy, density, ratio.

    Inner rings are weighed by density and ratio^1.5. Outer ones, grown from nucleoli, count in the first quarter of their rings,
    by density and ratio / 2.5 + 0.45; where both reach a cell the larger value stands.
    """
    mine = inner.join(profile, [*keys, "ring"]).select(*keys, "ix", "iy", "density", F.pow("ratio", F.lit(1.5)).alias("ratio"))
    if outer is None or outer_profile is None:
        return mine
    last = outer.groupBy(*keys).agg(F.max("ring").alias("__last"))
    near = _with(outer, last, keys).where(F.col("ring") <= F.round(F.col("__last") / 4)).drop("__last")
    theirs = near.join(outer_profile, [*keys, "ring"]).select(*keys, "ix", "iy", F.col("density").alias("__density"), (F.col("ratio") / 2.5 + 0.45).alias("__ratio"))
    both = mine.join(theirs, [*keys, "ix", "iy"], "full")
    return both.select(*keys, "ix", "iy", F.greatest("density", "__density").alias("density"), F.greatest("ratio", "__ratio").alias("ratio"))
