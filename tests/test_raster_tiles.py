"""Components by runs and smoothing by tiles, against flood fill and dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.operators import raster


def flood(grid, steps):
    """Component of each set cell: its smallest cell."""
    out, todo = {}, [tuple(map(int, c)) for c in np.argwhere(grid)]
    for c in todo:
        if c not in out:
            part, waiting = [], [c]
            out[c] = None
            while waiting:
                x = waiting.pop()
                part.append(x)
                for i, j in steps:
                    y = x[0] + i, x[1] + j
                    if 0 <= y[0] < grid.shape[0] and 0 <= y[1] < grid.shape[1] and grid[y] and y not in out:
                        out[y] = None
                        waiting.append(y)
            for x in part:
                out[x] = min(part)
    return out


@pytest.mark.parametrize("fill", [0.2, 0.5, 0.65, 0.95])
def test_components_and_holes_of_random_masks(spark, monkeypatch, fill):
    monkeypatch.setattr(raster, "STRIP", 4)
    rng = np.random.default_rng(int(fill * 100))
    grids = {k: rng.random((23, 31)) < fill for k in (1, 2)}
    rows = [(k, int(i), int(j)) for k, g in grids.items() for i, j in np.argwhere(g)]
    mask = spark.createDataFrame(rows, "cell int, ix int, iy int").repartition(3)
    shape = spark.createDataFrame([(k, 23, 31) for k in grids], "cell int, nx int, ny int")
    for steps in (raster.FOUR, raster.EIGHT):
        want = {(k, *c): v for k, g in grids.items() for c, v in flood(g, steps).items()}
        got = raster.components(mask, steps, ["cell"]).collect()
        assert {(r["cell"], r["ix"], r["iy"]): (r["component"]["ix"], r["component"]["iy"]) for r in got} == want and len(got) == len(want)
        sizes = {}
        for (k, *_), v in want.items():
            sizes[k, v] = sizes.get((k, v), 0) + 1
        kept = {(k, v) for k in grids for v in sorted((v for c, v in sizes if c == k), key=lambda v: (-sizes[k, v], v))[:3]}  # noqa: B023
        assert {tuple(r) for r in raster.largest(raster.components(mask, steps, ["cell"]), 3, ["cell"]).collect()} == {c for c, v in want.items() if (c[0], v) in kept}
    filled = {tuple(r) for r in raster.fill_holes(mask, shape, ["cell"]).select("cell", "ix", "iy").collect()}
    for k, g in grids.items():
        outer = np.pad(~g, 1, constant_values=True)
        outside = {c for c, v in flood(outer, raster.FOUR).items() if v == (0, 0)}
        assert {c[1:] for c in filled if c[0] == k} == {(i, j) for i in range(23) for j in range(31) if (i + 1, j + 1) not in outside}
    one = mask.where("cell = 1").drop("cell")
    assert raster.largest(raster.components(one), 2).count() == sum(sorted((n for (k, _), n in _sizes(grids[1]).items()), reverse=True)[:2])
    assert raster.fill_holes(one.limit(0), shape.where("cell = 1").drop("cell")).count() == 0 and raster.components(one.limit(0)).count() == 0
    with pytest.raises(ValueError, match="four or eight"):
        raster.components(one, [(0, 1)])


def _sizes(grid):
    out = {}
    for v in flood(grid, raster.FOUR).values():
        out[1, v] = out.get((1, v), 0) + 1
    return out


@pytest.mark.parametrize("border", ["reflect", "replicate"])
def test_smoothing_by_tiles(spark, monkeypatch, border):
    rng = np.random.default_rng(4)
    for tile, (nx, ny), sigma in ((8, (30, 17), 1.5), (16, (5, 40), 2.0), (8, (3, 2), 2.0)):
        monkeypatch.setattr(raster, "TILE", tile)
        values = np.where(rng.random((nx, ny)) < 0.3, rng.integers(1, 9, (nx, ny)), 0)
        radius, kernel = int(4 * sigma + 0.5), np.array(raster.gaussian_kernel(sigma, int(4 * sigma + 0.5)))
        pad = lambda n: [(t if t < n else 2 * n - 1 - t) if border == "reflect" else min(max(a, 0), n - 1) for a in range(-radius, n + radius) for t in (a % (2 * n),)]
        wide = values[np.ix_(pad(nx), pad(ny))]
        want = sum(kernel[i] * kernel[j] * wide[i : i + nx, j : j + ny] for i in range(len(kernel)) for j in range(len(kernel)))
        grid = spark.createDataFrame([("a", int(i), int(j), int(values[i, j])) for i, j in np.argwhere(values)], "cell string, ix int, iy int, value long").repartition(3)
        shape = spark.createDataFrame([("a", nx, ny), ("b", 4, 4)], "cell string, nx int, ny int")
        got = raster.gaussian(grid, shape, sigma, border=border, keys=["cell"]).collect()
        assert len(got) == nx * ny + 16 and all(abs(r["value"] - (want[r["ix"], r["iy"]] if r["cell"] == "a" else 0)) < 1e-9 for r in got)
    sent = raster.tile_rows(spark.range(64).select((F.col("id") % 8).cast("int").alias("ix"), F.floor(F.col("id") / 8).cast("int").alias("iy")), 2, spark.createDataFrame([(8, 8)], "nx int, ny int"), tile=8)
    assert sent.count() == 64  # nothing leaves a grid of one tile


def brute_rings(free, seeds, steps, outside):
    """Rings by one pass over all cells for each ring; cells beyond the grid are like those that aren't free or seeds."""
    n, m = free.shape
    ring = np.where(seeds, 0, np.where(free, 10**9, outside))
    k = 0
    while True:
        k += 1
        new = [(x, y) for x, y in np.argwhere(free & (ring == 10**9)) if any((ring[x + i, y + j] if 0 <= x + i < n and 0 <= y + j < m else outside) < k for i, j in steps)]
        if not new:
            return {(int(x), int(y)): int(ring[x, y]) for x, y in np.argwhere(free & (ring < 10**9))}
        for c in new:
            ring[tuple(c)] = k


@pytest.mark.parametrize("steps", [raster.FOUR, raster.disk(2), ((1, 0), (0, -3), (0, 0))])
def test_waves_over_tiles(spark, monkeypatch, steps):
    monkeypatch.setattr(raster, "TILE", 5)
    rng = np.random.default_rng(6)
    masks = {1: rng.random((17, 24)) < 0.9, 2: np.ones((26, 9), bool), 3: np.zeros((4, 4), bool)}
    rows = [(k, int(i) - 7, int(j) - 3) for k, g in masks.items() for i, j in np.argwhere(g)]
    df = spark.createDataFrame(rows, "cell long, ix int, iy int").repartition(3)
    got = {(r["cell"], r["ix"] + 7, r["iy"] + 3): r["ring"] for r in raster.peel(df, steps, ["cell"]).collect()}
    assert got == {(k, *c): v for k, g in masks.items() for c, v in brute_rings(g, ~g, steps, 0).items()}
    inner = df.where("pmod(ix * 31 + iy * 17, 61) = 0")
    got = {(r["cell"], r["ix"] + 7, r["iy"] + 3): r["ring"] for r in raster.peel(inner, steps, ["cell"], inward=False, within=df).collect()}
    want = {}
    for k, g in masks.items():
        seeds = np.array([[g[i, j] and ((i - 7) * 31 + (j - 3) * 17) % 61 == 0 for j in range(g.shape[1])] for i in range(g.shape[0])], bool).reshape(g.shape)
        want |= {(k, *c): v for c, v in brute_rings(g & ~seeds, seeds, [(-i, -j) for i, j in steps], 10**9).items()}
    assert got == want and max(want.values()) > 3


def test_a_winding_front_crosses_tiles(spark, monkeypatch):
    """A spiral corridor: hundreds of rings, and rounds as many as tiles are crossed."""
    monkeypatch.setattr(raster, "TILE", 16)
    grid = np.zeros((40, 40), bool)
    for y in range(0, 40, 2):
        grid[:, y] = True
        if y + 1 < 40:
            grid[-1 if y % 4 == 0 else 0, y + 1] = True
    df = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(grid)], "ix int, iy int")
    seen, before = [], raster.checkpointed
    monkeypatch.setattr(raster, "checkpointed", lambda x: seen.append(1) or before(x))
    seeds = np.zeros_like(grid)
    seeds[0, 0] = True
    got = {(r["ix"], r["iy"]): r["ring"] for r in raster.peel(df.where("ix = 0 AND iy = 0"), raster.FOUR, inward=False, within=df).collect()}
    want = brute_rings(grid & ~seeds, seeds, raster.FOUR, 10**9)
    assert got == want and max(got.values()) > 700 and len(seen) < 80
