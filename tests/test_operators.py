"""Operators against brute force, and their invariants."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.functions import core
from nubila.functions.core import ranked, uniform
from nubila.operators import cluster, filters, fitting, profiles, raster, sampling, spatial

NONE = "id long, x double, y double, z double"


def cloud(spark, n=150, seed=1, span=300.0):
    p = np.random.default_rng(seed).uniform(0, span, (n, 3))
    return p, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], NONE)


def sequential_dbscan(p, eps, least):
    near = [np.flatnonzero(((p - q) ** 2).sum(axis=1) <= eps * eps) for q in p]
    labels, k = np.full(len(p), -1), 0
    for i in range(len(p)):
        if labels[i] == -1 and len(near[i]) >= least:
            todo, labels[i] = [i], k
            while todo:
                j = todo.pop()
                if len(near[j]) >= least:
                    for m in near[j]:
                        if labels[m] == -1:
                            labels[m] = k
                            todo.append(m)
            k += 1
    return labels


@pytest.mark.parametrize("eps,least", [(20, 4), (30, 5), (1000, 8), (1, 2)])
def test_dbscan_equals_a_sequential_scan(spark, eps, least):
    p, df = cloud(spark)
    got = {r["id"]: r["cluster_label"] for r in cluster.dbscan(df.repartition(5), eps, least).collect()}
    assert [got[i] for i in range(len(p))] == sequential_dbscan(p[:, :2], eps, least).tolist()


def test_range_join_and_rings_equal_brute_force(spark):
    p, df = cloud(spark, 80)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    pairs = {(r["a_id"], r["b_id"]) for r in spatial.range_join(df, df, 60.0).collect()}
    assert pairs == set(zip(*map(list, np.nonzero(d <= 60)), strict=True))
    rings = spatial.ring_counts(df, df, 60.0, same=True).collect()
    assert len(rings) == 80 * 6 and all(r["within"] == (d[r["id"]] <= r["ring"] * 10).sum() - 1 for r in rings)
    last = {r["id"]: r["within"] for r in rings if r["ring"] == 6}
    total = {}
    for r in rings:
        total[r["id"]] = total.get(r["id"], 0) + r["in_ring"]
    assert total == last


def test_points_at_exactly_the_radius_and_far_below_zero(spark):
    df = spark.createDataFrame([(1, -100.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 100.0, 0.0, 0.0), (4, 100.0, 0.0, 0.0)], NONE)
    assert spatial.range_join(df, df, 100.0).count() == 4 + 2 + 2 * 2 + 2
    assert spatial.ring_counts(df, df.limit(0), 30.0).agg(F.sum("within")).first()[0] == 0
    assert spatial.range_join(df.limit(0), df, 10.0).count() == 0


def test_nearest_equals_brute_force(spark):
    p, df = cloud(spark, 60)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    got = {r["id"]: r["distance"] for r in spatial.mean_nearest(df, df, 10, 1000.0).collect()}
    assert all(abs(got[i] - np.sort(d[i])[:10].mean()) < 1e-9 for i in range(60))
    wide = {r["id"]: r["distance"] for r in spatial.adaptive_mean_nearest(df, 5, 60, 70.0).collect()}
    assert all(abs(wide[i] - np.sort(d[i])[1:5].mean()) < 1e-9 for i in range(60))
    assert spatial.adaptive_mean_nearest(df.limit(3)).count() == 3


def test_hulls():
    cube = np.array([[i, j, k] for i in (0, 2) for j in (0, 2) for k in (0, 2)], float)
    inside = np.random.default_rng(0).uniform(0.1, 1.9, (50, 3))
    volume, corners = cluster.hull_3d(np.vstack([cube, inside, cube]))
    assert abs(volume - 8) < 1e-9 and len(corners) == 8 and cluster.area_2d(np.vstack([cube, inside])[:, :2]) == 4
    assert cluster.hull_3d(cube[:, [0, 0, 1]])[0] == 0 and cluster.hull_3d(cube[:3])[0] == 0 and cluster.area_2d(np.array([[0, 0], [1, 1], [2, 2]])) == 0
    v = np.random.default_rng(1).normal(size=(400, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert 3.9 < cluster.hull_3d(v)[0] < 4 / 3 * math.pi


def test_geometry_of_degenerate_clusters(spark):
    rows = [(i, float(i % 2), float(i // 2 % 2), float(i // 4), 0) for i in range(8)] + [(10 + i, float(i % 3), float(i // 3), 5.0, 1) for i in range(9)] + [(30 + i, 0.0, float(i), 0.0, 2) for i in range(3)] + [(40, 1.0, 1.0, 1.0, -1)]
    df = spark.createDataFrame(rows, NONE + ", cluster_label int")
    got = {r["cluster_label"]: r for r in cluster.cluster_geometry(df).collect()}
    assert set(got) == {0, 1, 2} and got[0]["hull_3D"] == 1 and got[0]["bb_3D"] == 1 and got[0]["density_2D"] == 8
    assert got[1]["hull_2D"] == got[1]["bb_2D"] == 0 == got[2]["hull_3D"] and got[1]["vertices"] == []


def sparse(spark, image):
    return spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(image), strict=True)], "ix int, iy int")


def shape(spark, image):
    return spark.createDataFrame([image.shape], "nx int, ny int")


def full(df, image, column=None):
    out = np.zeros(image.shape)
    for r in df.collect():
        out[r["ix"], r["iy"]] = r[column] if column else 1
    return out


def test_raster_morphology_equals_dense_arrays(spark):
    image = np.random.default_rng(4).uniform(size=(14, 11)) < 0.62
    mask, box = sparse(spark, image), shape(spark, image)
    off = raster.disk(1)
    padded = np.pad(image, 1)
    eroded = np.all([padded[1 + i : 15 + i, 1 + j : 12 + j] for i, j in off], axis=0)
    assert (full(raster.erode(mask, off), image) == eroded).all()
    grown = np.any([padded[1 + i : 15 + i, 1 + j : 12 + j] for i, j in off], axis=0)
    assert (full(raster.dilate(mask, off, raster.dense(box)), image) == grown).all()
    zero = np.argwhere(~image)
    want = {(i, j): np.sqrt(((zero - (i, j)) ** 2).sum(axis=1).min()) for i, j in np.argwhere(image).tolist()}
    got = {(r["ix"], r["iy"]): r["distance"] for r in raster.distance_map(mask, box).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    rings = {(r["ix"], r["iy"]): r["ring"] for r in raster.peel(mask, off).collect()}
    assert rings.keys() == want.keys() and min(rings.values()) == 1
    outward = raster.peel(mask.where("ix = 5 and iy = 5").union(spark.createDataFrame([(5, 5)], "ix int, iy int")).distinct(), off, inward=False, within=raster.dense(box))
    assert outward.count() == 14 * 11 - 1


def test_holes_components_and_smoothing(spark):
    image = np.zeros((9, 9), bool)
    image[1:6, 1:6] = True
    image[3, 3] = False
    image[7, 7] = image[8, 8] = True
    mask, box = sparse(spark, image), shape(spark, image)
    assert raster.fill_holes(mask, box).count() == image.sum() + 1
    assert raster.component_sizes(raster.components(mask)).count() == 3 and raster.component_sizes(raster.components(mask, raster.EIGHT)).count() == 2
    assert raster.largest(raster.components(mask)).count() == 24
    values = np.random.default_rng(2).poisson(1.0, (6, 40))
    grid = spark.createDataFrame([(int(i), int(j), int(values[i, j])) for i, j in np.argwhere(values > 0)], "ix int, iy int, value long")
    for border, mode in (("reflect", "symmetric"), ("replicate", "edge")):
        r = 8
        k = np.array(raster.gaussian_kernel(2.0, r))
        p = np.pad(values.astype(float), r, mode=mode)
        want = np.array([[(p[i : i + 2 * r + 1, j : j + 2 * r + 1] * np.outer(k, k)).sum() for j in range(40)] for i in range(6)])
        assert np.allclose(full(raster.gaussian(grid, shape(spark, values), 2.0, border=border), values, "value"), want)


def test_sampling_is_keyed(spark):
    df = spark.range(101).withColumn("x", F.col("id") * 1.0)
    n = {round(r["fraction"], 1): r["count"] for r in sampling.sample_fractions(df).groupBy("fraction").count().collect()}
    assert n[1.0] == 101 and n[0.5] == 51 and n[0.1] == 10
    once = sorted(r["id"] for r in sampling.sample_fractions(df.repartition(7)).where("fraction < 0.15").collect())
    assert once == sorted(r["id"] for r in sampling.sample_fractions(df.coalesce(1)).where("fraction < 0.15").collect())
    u = np.array([r[0] for r in spark.range(4000).select(uniform("id", 1)).collect()])
    assert 0.48 < u.mean() < 0.52 and 0 <= u.min() and u.max() < 1
    counts = np.array([r[0] for r in spark.range(4000).select(sampling.poisson(uniform("id", 3), F.lit(2.5))).collect()])
    assert abs(counts.mean() - 2.5) < 0.1 and abs(counts.var() - 2.5) < 0.25
    noisy = sampling.camera_noise(spark.range(3000).select(F.lit(1).alias("frame"), F.col("id").alias("ix"), F.lit(0).alias("iy"), F.lit(100.0).alias("photons")))
    assert abs(noisy.agg(F.avg("signal")).first()[0] - 100) < 2
    seeds = spark.createDataFrame([(1, 2), (3, 4)], "ix int, iy int")
    drawn = sampling.with_random_z(seeds, spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, z double")).collect()
    assert len(drawn) == 2 and {r["z"] for r in drawn} <= {5.0, 6.0}
    two = spark.range(500).select(F.col("id").alias("ix"), F.lit(0).alias("iy"), F.lit(0).alias("iz"), F.lit(0.2).alias("t_m"), F.lit(0.3).alias("t_a"))
    by = {r["channel"]: r["count"] for r in sampling.plant_two_channels(two).groupBy("channel").count().collect()}
    assert 60 < by["C1"] < 140 and 110 < by["C2"] < 190


def test_fits_and_searches(spark):
    a, b = fitting.fit_exponential(np.arange(1, 20.0), 5 * np.exp(-0.3 * np.arange(1, 20.0)))
    assert abs(a - 5) < 1e-6 and abs(b + 0.3) < 1e-8
    x = np.sin(np.linspace(0, 6, 40))
    up = fitting.resample(x, 100, 40)
    assert len(up) == 100 and np.abs(up[10:-15] - np.interp(np.arange(100) * 0.4, np.arange(40), x)[10:-15]).max() < 0.05
    assert abs(fitting.bounded_minimum(lambda e: (e - 77) ** 2, 10, 200, 0.01, 60)[0] - 77) < 0.05
    eps, cost, steps = fitting.halving_search(lambda e: e - 43.7)
    assert abs(cost) <= 1.3 and steps < 20
    assert fitting.until_close(lambda k: 1 / k) == (4, 0.25) and fitting.until_close(lambda k: 9.0)[0] == 10
    rows = spark.createDataFrame([(float(d), 3 * d**-0.5) for d in (1, 2, 5, 9)] + [(0.0, 1.0)], "d double, e double")
    r = fitting.power_law(rows, "d", "e").first()
    assert abs(r["coef"] - 3) < 1e-9 and abs(r["exp"] + 0.5) < 1e-9 and abs(r["r2"] - 1) < 1e-9
    _, df = cloud(spark, 120, span=150.0)
    found = fitting.find_eps(df, 60.0, 10, 60, min_samples=4, tolerance=10.0)
    assert 10 <= found[0] <= 60


def test_profiles_and_filters(spark):
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 3, 5, 5, 4, 2, 2, 1], 1)], "ring int, value double")
    assert [r["ring"] for r in profiles.falling_segment(p).orderBy("ring").collect()] == [4, 5]
    assert profiles.width_at(p, share=0.5).first()["width"] == 20.0 and profiles.scaled_by_max(p).agg(F.max("scaled")).first()[0] == 1
    up = profiles.calibration_update(p, p.withColumn("value", F.col("value") * 2), p.withColumn("value", F.lit(1.0))).collect()
    assert {r["factor"] for r in up} == {0.5} and up[0]["dif"] == 1.0
    diff = profiles.ring_difference(p.withColumn("k", F.lit(1)), "value", ["k"]).orderBy("ring")
    assert [r["in_ring"] for r in diff.collect()] == [1, 2, 2, 0, 0, 0, 0, 0]
    h = profiles.ring_histogram(p.withColumn("in_ring", F.col("value")), share=True)
    assert h.count() == sum([2, 4, 6, 6, 5, 3, 3, 2]) and profiles.expected_shell_counts(h).count() == 8
    assert filters.drop_unstable_start(p.withColumn("value", F.when(F.col("ring") == 1, 1e9).otherwise(F.col("value"))), "value", []).count() == 7
    w = spark.createDataFrame([(12.5,)], "d double").select(filters.displacement_of(filters.wavelength_of(F.col("d"), 0.5, 2.0, 600.0), 0.5, 2.0, 600.0)).first()[0]
    assert abs(w - 12.5) < 1e-9
    z = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 9.0)], "id long, z double")
    assert filters.filter_axial(z, 0.5).count() == 1 and filters.filter_axial(z.limit(0)).count() == 0 and filters.filter_quantile(z, "z", 0.0).count() == 3
    colours = spark.range(-1, 2).select(filters.cluster_color(F.col("id")).alias("c")).collect()
    assert colours[0]["c"] == [0.7, 0.7, 0.7, 0.5] and colours[1]["c"] != colours[2]["c"]


def test_ranked_is_the_place_in_the_whole_order(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 5, 500))]
    got = ranked(spark.createDataFrame(rows, "id long, v long").repartition(7), "v", "id").collect()
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert {r["id"]: r["rank"] for r in got} == want
    assert ranked(spark.createDataFrame([], "id long"), "id").count() == 0


def test_poisson_has_no_upper_bound(spark):
    """Counts are the inverse distribution at any rate."""
    for rate in (0.0, 0.3, 7.0, 100.0, 900.0):
        got = [r["n"] for r in spark.range(400).select(sampling.poisson(uniform("id", 3), F.lit(rate)).alias("n")).collect()]
        assert abs(np.mean(got) - rate) <= 4 * math.sqrt(rate / 400) + 1e-9
        u = [r["u"] for r in spark.range(400).select(uniform("id", 3).alias("u")).collect()]
        for a, n in list(zip(u, got, strict=True))[:40]:
            below = sum(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(n)) if rate else 0.0
            assert below <= a + 1e-9 and (rate == 0 or a <= below + math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1)) + 1e-9)


def test_distance_map_of_random_masks(spark):
    rng = np.random.default_rng(8)
    for fill in (0.3, 0.9, 0.99):
        grid = rng.random((23, 17)) < fill
        cells = [(int(i), int(j)) for i, j in np.argwhere(grid)]
        shape = spark.createDataFrame([(23, 17)], "nx int, ny int")
        got = {(r["ix"], r["iy"]): r["distance"] for r in raster.distance_map(spark.createDataFrame(cells, "ix int, iy int"), shape).collect()}
        free = np.argwhere(~grid)
        for c in cells:
            want = math.sqrt(((free - c) ** 2).sum(axis=1).min()) if len(free) else None
            assert got[c] == want or abs(got[c] - want) < 1e-9
    full = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "ix int, iy int")
    assert {r["distance"] for r in raster.distance_map(full, spark.createDataFrame([(3, 3)], "nx int, ny int")).collect()} == {None}


def test_costs_at_several_radii_share_one_join(spark):
    p, df = cloud(spark, 200, 3, 200.0)
    got = {r["eps"]: r["cost"] for r in fitting.eps_grid_cost(df, (10.0, 20.0, 30.0), 40.0, 4).collect()}
    for eps in got:
        value = fitting.sizes_at(df, eps, 4, "bb_2D").agg(F.avg("bb_2D")).first()[0]
        assert abs(got[eps] - (abs(value - 40.0) if value is not None else fitting.NO_CLUSTER)) < 1e-9


def test_bounded_search_is_no_worse_than_a_grid(spark):
    p, df = cloud(spark, 200, 3, 200.0)
    eps, cost = fitting.find_eps(df, 40.0, 10.0, 60.0, 4, tolerance=8.0)
    grid = min(r["cost"] for r in fitting.eps_grid_cost(df, (10.0, 60.0), 40.0, 4).collect())
    assert 10 <= eps <= 60 and cost <= grid + 1e-9


def test_decay_constants_follow_the_segment(spark):
    rng = np.random.default_rng(9)
    centres = rng.uniform(0, 2000, (25, 3))
    near = np.concatenate([c + rng.normal(0, 25, (20, 3)) for c in centres])
    own = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(near)], NONE)
    other = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 2000, (3000, 3)))], NONE)
    part = {r["r"]: r["value"] for r in profiles.decay_segments(own, other, 300.0).collect()}
    fit = profiles.decay_constants(own, other, 300.0).collect()
    assert len(part) > 3 and len(fit) == 1 and fit[0]["b"] < 0
    error = lambda a, b: sum((a * math.exp(b * r) - v) ** 2 for r, v in part.items())
    best = error(fit[0]["a"], fit[0]["b"])
    assert all(error(fit[0]["a"] * (1 + i * 0.02), fit[0]["b"] * (1 + j * 0.02)) >= best - 1e-9 for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_random_nucleus_holds_its_nucleoli(spark):
    rows = sampling.random_nucleus(spark, 3, 14.0, 2, 2.5, 80, 24, seed=4).collect()
    nucleus = {(r["slice"], r["ix"], r["iy"]) for r in rows}
    spots = {(r["slice"], r["ix"], r["iy"]) for r in rows if r["part"] == "nucleolus"}
    assert len(rows) == len(nucleus) and {s for s, _, _ in spots} == {0, 1, 2} and len(spots) % 3 == 0
    assert all((s, x, y) in nucleus for s in range(3) for _, x, y in spots)
    todo, parts = {(x, y) for _, x, y in spots}, 0
    while todo:
        parts, front = parts + 1, [todo.pop()]
        while front:
            x, y = front.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in todo:
                    todo.remove(c)
                    front.append(c)
    assert parts in (1, 2)  # two that touch look like one


def test_weighted_rings_without_nucleoli(spark):
    rings = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "ix int, iy int, ring int")
    profile = spark.createDataFrame([(1, 2.0, 4.0), (2, 3.0, 0.25)], "ring int, density double, ratio double")
    assert {(r["iy"], r["density"], r["ratio"]) for r in raster.weighted_rings(rings, profile).collect()} == {(0, 2.0, 8.0), (1, 3.0, 0.125)}


def test_checkpoints_inside_a_block_are_deleted(spark):
    outer = core.checkpointed(spark.range(3))
    with core.checkpoints_dropped(spark):
        inner = core.checkpointed(spark.range(4))
        path = core._WRITTEN[-1]
        assert inner.count() == 4 and os.path.isdir(path.removeprefix("file:"))
    assert outer.count() == 3 and not os.path.exists(path.removeprefix("file:"))
    with pytest.raises(ZeroDivisionError), core.checkpoints_dropped(spark):
        core.checkpointed(spark.range(1))
        path = core._WRITTEN[-1]
        raise ZeroDivisionError
    assert not os.path.exists(path.removeprefix("file:"))


def test_calibration_of_factors(spark):
    """Against the same rounds in plain Python; rings without a real value keep their factor."""
    real, factor = {1: 2.0, 2: 5.0, 3: 1.0}, dict.fromkeys((1, 2, 3, 4), 1.0)
    frame = lambda d, name: spark.createDataFrame(list(d.items()), f"ring int, {name} double")
    model = lambda f: f.select("ring", (4 * F.sqrt("value")).alias("value"))
    found, rounds = fitting.calibrated_factors(model, frame(real, "value"), frame(factor, "factor"), 0.1)
    want, k, worst = dict(factor), 0, 9.0
    while worst > 0.1 and k < 10:
        ratio = {r: 4 * math.sqrt(want[r]) / real[r] for r in real}
        want, k, worst = {r: v / ratio.get(r, 1) for r, v in want.items()}, k + 1, max(abs(v - 1) for v in ratio.values())
    assert rounds == k and all(abs(r["factor"] - want[r["ring"]]) < 1e-9 for r in found.collect())


def test_counts_on_a_line_make_no_pairs(spark, monkeypatch):
    """Against all pairs, with differences of exactly the reach, gaps, equal values and parts; then 10^11 pairs at one place."""
    monkeypatch.setattr(spatial, "ROWS", 7)
    rng = np.random.default_rng(11)
    a, b = np.round(rng.normal(0, 40, 60), 2).tolist(), np.round(rng.normal(0, 40, 300), 2).tolist()
    b += [v - 20 for v in a[:10]] + [v + 20 for v in a[10:20]] + b[:50]
    a += [5000.0]
    left = spark.createDataFrame([*enumerate(a), (999, None)], "id long, v double")
    right = spark.createDataFrame([*((v,) for v in b), (None,)], "v double")
    want = {i: n for i, v in enumerate(a) if (n := sum(abs(v - w) <= 20 for w in b))}
    assert {r["id"]: r["n"] for r in spatial.line_counts(left, right, 20.0, "v").collect()} == want
    monkeypatch.undo()
    crowd = spark.range(300_000).select("id", (F.rand(3) * 10).alias("v"))
    assert [tuple(r) for r in spatial.line_counts(crowd, crowd, 20.0, "v").groupBy("n").count().collect()] == [(300_000, 300_000)]


def test_ring_counts_of_crowds_equal_ring_counts(spark, monkeypatch):
    for name, n in (("CROWD", 7), ("OTHERS", 30), ("HELD", 100)):
        monkeypatch.setattr(spatial, name, n)
    p, df = cloud(spark, 150, 5, 120.0)
    grid = df.withColumns({a: F.round(a, -1) for a in "xyz"})  # distances at the edges of rings
    far = spark.createDataFrame([(9999, 1e6, 0.0, 0.0)], "id long, x double, y double, z double")
    both = grid.select("id", "x", "y", "z").unionByName(far)
    for axes in (("x", "y"), ("x", "y", "z")):
        rows = lambda df: sorted(tuple(r) for r in df.select("id", "ring", "in_ring", "within").collect())
        assert rows(spatial.crowded_ring_counts(both, both, 60.0, 10.0, axes)) == rows(spatial.ring_counts(both, both, 60.0, 10.0, axes))


def test_ring_counts_by_keys_make_no_pairs(spark, monkeypatch):
    """Brute force over groups, parts, repeated ids and nulls; the plan holds no join of points with points."""
    for name, n in (("CROWD", 9), ("OTHERS", 25), ("BLOCK", 4), ("HELD", 40), ("TASK", 50)):
        monkeypatch.setattr(spatial, name, n, raising=False)
    schema = "id long, x double, y double, z double, cell long, kind string"
    rng = np.random.default_rng(9)
    rows = [(i, *(float(v) for v in np.round(rng.normal(0, 25, 3), i % 2)), i % 3, "ab"[i % 2]) for i in range(160)]
    rows += [(7, 1.0, 2.0, 3.0, 1, "b"), (None, 0.0, 0.0, 0.0, 0, "a"), (900, None, 0.0, 0.0, 0, "a"), (901, float("nan"), 0.0, 0.0, 0, "a"), (902, float("inf"), 0.0, 0.0, 0, "a"), (903, 0.0, 0.0, 0.0, None, "a")]
    df, keys = spark.createDataFrame(rows, schema).repartition(3), ["cell", "kind"]
    for axes in (("x", "y"), ("x", "y", "z")):
        place = lambda r: np.array(r[1 : 1 + len(axes)], dtype=float)  # noqa: B023, E731
        for same in (True, False):
            want = {}
            for r in rows:
                if r[0] is None or r[0] == 7:
                    continue
                mates = [o for o in rows if None not in (r[4], o[4]) and r[4:] == o[4:] and not (same and o[0] in (None, r[0]))]
                d = np.array([np.sqrt(((place(r) - place(o)) ** 2).sum()) for o in mates])
                want.update({(r[0], k): int((d <= 10.0 * k).sum()) for k in range(1, 6)})
            found = spatial.ring_counts(df, df, 50.0, 10.0, axes, keys, same)
            assert not any("Join" in line and "b_x" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
            got = found.where("id <> 7").collect()
            assert {(r["id"], r["ring"]): r["within"] for r in got} == want
            assert all(r["in_ring"] == r["within"] - (want[r["id"], r["ring"] - 1] if r["ring"] > 1 else 0) for r in got)
    # 400 million pairs.
    monkeypatch.undo()
    crowd = spark.range(20_000).select("id", F.lit(1).alias("cell"), *[(F.rand(i) * 5).alias(a) for i, a in enumerate("xyz")])
    assert [tuple(r) for r in spatial.ring_counts(crowd, crowd, 20.0, keys=["cell"], same=True).groupBy("ring", "within").count().orderBy("ring").collect()] == [(1, 19_999, 20_000), (2, 19_999, 20_000)]
