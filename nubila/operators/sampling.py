"""Seeded sampling and simulation. Every draw is a hash of a key and the seed, so results don't depend on partitions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed, ranked, uniform


def sample_fractions(df: DataFrame, steps: int = 10, seed: int = 42, keys: Sequence[str] = (), key: str = "id") -> DataFrame:
    """Uniform samples without replacement at fractions 1, (steps-1)/steps, ..., 1/steps, in one table with fraction.

    Each has exactly round(fraction n) rows; smaller samples are parts of larger ones.
    """
    drawn = df.withColumn("__u", uniform(key, seed))
    if keys:
        w = Window.partitionBy(*keys)
        placed = drawn.withColumn("__rank", F.row_number().over(w.orderBy("__u", key))).withColumn("__n", F.count("*").over(w))
    else:
        placed = ranked(drawn, "__u", key, rank="__rank")
        placed = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("__n"))))
    each = placed.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return each.where(F.col("__rank") <= F.round(F.col("__n") * F.col("__k") / steps)).withColumn("fraction", F.col("__k") / steps).drop("__u", "__rank", "__n", "__k")


def stride_sample(df: DataFrame, stride: int, order: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Rows 1, 1 + stride, ... in order."""
    placed = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))) if keys else ranked(df, order, rank="__rank")
    return placed.where((F.col("__rank") - 1) % stride == 0).drop("__rank")


def evenly_picked(df: DataFrame, picks: int, order: str = "id") -> DataFrame:
    """Rows at evenly spaced places of an order, the first and the last among them, with their place from 1."""
    placed = ranked(df, order, rank="place")
    n = placed.agg(F.max("place").alias("__n"))
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("i"), "__n").select((1 + F.round(F.col("i") * (F.col("__n") - 1) / max(picks - 1, 1))).cast("long").alias("place"))
    return placed.join(F.broadcast(wanted.distinct()), "place", "left_semi")


def poisson(u: Column, rate: Column) -> Column:
    """Poisson count by inverse distribution: the number of cumulative probabilities at or below u.

    Terms are summed in the logarithm as far as rate + 12 sqrt(rate) + 40, beyond which less probability lies than u resolves.
    """
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate / k)
        return F.struct(log_p.alias("log_p"), (acc["cdf"] + F.exp(log_p)).alias("cdf"), (acc["n"] + F.when(acc["cdf"] <= u, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(terms, start, step, lambda acc: acc["n"])).otherwise(0)


def _placed(cells: DataFrame, px: float, x0: float, y0: float, seed: int, key: Column) -> DataFrame:
    jitter = lambda i, o, a: F.lit(o) + (F.col(i) + uniform(key, f"{a}{seed}")) * px
    return cells.withColumn("x", jitter("ix", x0, "x")).withColumn("y", jitter("iy", y0, "y"))


def plant_seeds(probability: DataFrame, px: float = 50.0, scale: float = 1.0, x0: float = 0.0, y0: float = 0.0, seed: int = 1) -> DataFrame:
    """A seed in a cell (ix, iy, probability) with probability times scale, at a random place inside it."""
    cell = F.concat_ws(",", "ix", "iy")
    return _placed(probability.where(uniform(cell, seed) < F.col("probability") * scale), px, x0, y0, seed, cell)


def plant_seeds_poisson(probability: DataFrame, px: float = 50.0, scale: float = 1.0, x0: float = 0.0, y0: float = 0.0, seed: int = 1) -> DataFrame:
    """A Poisson number of seeds in each cell, each at its own place: ix, iy, copy, x, y."""
    cell = F.concat_ws(",", "ix", "iy")
    counted = probability.withColumn("count", poisson(uniform(cell, seed), F.col("probability") * scale)).where("count > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    return _placed(copies, px, x0, y0, seed, F.concat_ws(",", "ix", "iy", "copy"))


def plant_two_channels(cells: DataFrame, seed: int = 1) -> DataFrame:
    """One roll for each voxel with thresholds t_m and t_a: below t_m the first channel, above 1 - t_a the second."""
    u = uniform(F.concat_ws(",", "ix", "iy", "iz"), seed)
    return cells.withColumn("channel", F.when(u < F.col("t_m"), "C1").when(u > 1 - F.col("t_a"), "C2")).where("channel is not null")


def seed_thresholds(cells: DataFrame, n_first: float, n_second: float, area_ratio: float, first_volume: float = 561_000_000.0, second_volume: float = 425_110_000.0) -> DataFrame:
    """cells (density, ratio, slice_share) with t_m and t_a, the chances of a seed of either channel in a voxel.

    area_ratio is the real nucleus's area over the simulated one's; a ratio of 0 gives no second seeds.
    """
    first = n_first * F.col("density") * F.col("slice_share") / (first_volume * area_ratio)
    second = F.try_divide(n_second * F.col("density"), F.col("ratio")) * F.col("slice_share") / (second_volume * area_ratio)
    return cells.withColumn("t_m", first).withColumn("t_a", F.coalesce(second, F.lit(0.0)))


def with_random_z(seeds: DataFrame, z: DataFrame, seed: int = 1, key: Column | None = None) -> DataFrame:
    """seeds with z drawn with replacement from a column of observed values (id, z), by random rank."""
    places = ranked(z.select("id", "z"), "id", rank="__rank")
    n = places.agg(F.max("__rank").alias("__n"))
    key = F.concat_ws(",", "ix", "iy") if key is None else key
    drawn = seeds.crossJoin(F.broadcast(n)).withColumn("__rank", (F.floor(uniform(key, f"z{seed}") * F.col("__n")) + 1).cast("long")).drop("__n")
    return drawn.join(places.select("__rank", "z"), "__rank").drop("__rank")


def cumulative(histogram: DataFrame, keys: Sequence[str] = ("ring",)) -> DataFrame:
    """Histogram (ring, k, freq) with its cumulative distribution, and the value before each step."""
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cdf = F.sum("freq").over(w) / F.sum("freq").over(Window.partitionBy(*keys))
    return histogram.withColumn("cdf", cdf).withColumn("before", F.coalesce(F.lag("cdf").over(Window.partitionBy(*keys).orderBy("k")), F.lit(-1.0)))


def spawn_domains(seeds: DataFrame, histogram: DataFrame, step: float = 10.0, z_degradation: float = 1.5, ring_offset: int = 0, seed: int = 1) -> DataFrame:
    """Localizations around seeds (seed_id, x, y, z): in each ring a count drawn from the ring's histogram (ring, k, freq).

    The count is the first k whose cumulative share reaches the roll; radius lies in the ring, directions are uniform on the
    sphere and dz is stretched. ring_offset 0 puts ring k at [k step, (k+1) step), -1 where it was counted.
    """
    steps = cumulative(histogram)
    rings = seeds.crossJoin(steps.select("ring").distinct())  # a histogram has some dozens of rings
    rolled = rings.withColumn("u", uniform(F.concat_ws(",", "seed_id", "ring"), seed)).alias("s").join(steps.alias("h"), (F.col("s.ring") == F.col("h.ring")) & (F.col("u") <= F.col("cdf")) & (F.col("u") > F.col("before")))
    rolled = rolled.select("s.*", "h.k").where("k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    key = F.concat_ws(",", "seed_id", "ring", "copy")
    r = (F.col("ring") + ring_offset + uniform(key, f"r{seed}")) * step
    theta, phi = 2 * math.pi * uniform(key, f"t{seed}"), F.acos(2 * uniform(key, f"p{seed}") - 1)
    placed = rolled.withColumn("__r", r).withColumn("__t", theta).withColumn("__p", phi)
    across = F.col("__r") * F.sin("__p")
    return placed.select("seed_id", "ring", "copy", (F.col("x") + across * F.cos("__t")).alias("x"), (F.col("y") + across * F.sin("__t")).alias("y"), (F.col("z") + F.col("__r") * F.cos("__p") * z_degradation).alias("z"), F.col("seed_id").alias("cluster_label"), F.lit(110.0).alias("sigma_x"))


def spawn_rings(seeds: DataFrame, histogram: DataFrame, shrink: DataFrame, step: float = 10.0, z_spread: float = 2.8, seed: int = 1) -> DataFrame:
    """Localizations around seeds (seed_id, x, y, z) on flat rings with an axial spread.

    For each seed and ring the first bin (histogram: ring, k, freq) whose cumulative share exceeds the roll is taken; the count is
    the rounded middle of its edges k and k + 1, each first divided by 6 ratio and rounded. shrink: ring, ratio, z_ratio. A point
    lies at ring + u steps in a random direction, and z_spread * sqrt(r'^2 / 2) / z_ratio above or below, r' within a step of ring.
    """
    steps = cumulative(histogram).withColumn("before", F.greatest("before", F.lit(0.0)))
    edge = lambda k: F.round(k / (6 * F.col("ratio")))
    counted = steps.join(shrink, "ring").withColumn("count", F.round((edge(F.col("k")) + edge(F.col("k") + 1)) / 2).cast("int"))
    rings = seeds.crossJoin(shrink.select("ring"))  # a histogram has some dozens of rings
    rolled = rings.withColumn("u", uniform(F.concat_ws(",", "seed_id", "ring"), seed)).alias("s").join(counted.alias("h"), (F.col("s.ring") == F.col("h.ring")) & (F.col("u") < F.col("cdf")) & (F.col("u") >= F.col("before")))
    copies = rolled.where("count > 0").select("s.*", "h.z_ratio", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    key = F.concat_ws(",", "seed_id", "ring", "copy")
    far, angle = (F.col("ring") + uniform(key, f"r{seed}")) * step, 2 * math.pi * uniform(key, f"t{seed}")
    axial = (F.col("ring") + 2 * uniform(key, f"a{seed}") - 1) * step
    side = F.when(uniform(key, f"s{seed}") < 0.5, -1.0).otherwise(1.0)
    return copies.select("seed_id", "ring", "copy", (F.col("x") + far * F.cos(angle)).alias("x"), (F.col("y") + far * F.sin(angle)).alias("y"), (F.col("z") + z_spread * side * F.sqrt(axial * axial / 2) / F.col("z_ratio")).alias("z"))


def random_radii(spark: SparkSession, vertices: int = 250, radius: float = 60.0, wobble: float = 0.02, seed: int = 1) -> DataFrame:
    """(order, r): radii of an outline's vertices, which walk randomly and return to their start."""
    rows = spark.range(1, vertices + 1).select(F.col("id").alias("order"))
    normal = F.sqrt(-2 * F.ln(1 - uniform("order", f"a{seed}"))) * F.cos(2 * math.pi * uniform("order", f"b{seed}"))
    # An outline has some hundreds of vertices.
    w = Window.partitionBy(F.lit(0)).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    walk = rows.withColumn("step", normal * wobble).withColumn("walk", F.sum("step").over(w)).withColumn("end", F.sum("step").over(whole))
    return walk.select("order", (radius * F.exp(F.col("walk") - F.col("end") * F.col("order") / vertices)).alias("r"))


def _vertex(centre: tuple[float, float], vertices: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.col("order") / vertices
    return F.round(centre[0] + F.col("r") * F.cos(angle)).cast("int").alias("ix"), F.round(centre[1] + F.col("r") * F.sin(angle)).cast("int").alias("iy")


def random_outline(spark: SparkSession, vertices: int = 250, radius: float = 60.0, wobble: float = 0.02, seed: int = 1, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Integer vertices (order, ix, iy) of a closed outline whose radius walks randomly and returns to its start."""
    return random_radii(spark, vertices, radius, wobble, seed).select("order", *_vertex(centre, vertices))


def random_nucleus(spark: SparkSession, slices: int = 20, radius: float = 60.0, nucleoli: int = 2, nucleolus_radius: float = 10.0, vertices: int = 250, nucleolus_vertices: int = 75, wobble: float = 0.02, seed: int = 1, most: int = 100) -> DataFrame:
    """Cells of a simulated nucleus: slice, ix, iy, part ("nucleus" or "nucleolus").

    The outlines of the lowest and the highest slice walk randomly; those between are interpolated. Each nucleolus is an outline at
    a random place that is drawn again until it lies inside the nucleus in every slice and touches no other one.
    """
    from nubila.operators import raster

    middle = math.ceil(2 * radius)
    shape = spark.range(1).select(F.lit(2 * middle).alias("nx"), F.lit(2 * middle).alias("ny"))
    low, high = (random_radii(spark, vertices, radius, wobble, f"{seed}{end}").withColumnRenamed("r", end) for end in ("low", "high"))
    levels = spark.range(slices).select(F.col("id").cast("int").alias("slice"))
    between = low.join(high, "order").crossJoin(F.broadcast(levels)).withColumn("r", F.col("low") + (F.col("high") - F.col("low")) * F.col("slice") / max(slices - 1, 1))
    body = checkpointed(raster.filled_outline(between.select("slice", "order", *_vertex((middle, middle), vertices)), levels.crossJoin(F.broadcast(shape)), ["slice"]))
    inside = checkpointed(body.groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") == slices).select("ix", "iy"))
    taken, found = None, 0
    for attempt in range(most):
        if found == nucleoli:
            break
        draw = [int(hashlib.md5(f"{attempt}:{seed}{axis}".encode()).hexdigest()[:8], 16) / 2**32 for axis in "rt"]
        far, angle = radius * math.sqrt(draw[0]), 2 * math.pi * draw[1]
        centre = (middle + far * math.cos(angle), middle + far * math.sin(angle))
        cells = checkpointed(raster.filled_outline(random_outline(spark, nucleolus_vertices, nucleolus_radius, wobble, f"{seed}n{attempt}", centre), shape))
        outside = not cells.join(inside, ["ix", "iy"], "left_anti").isEmpty()
        if outside or (taken is not None and not cells.join(taken, ["ix", "iy"], "left_semi").isEmpty()):
            continue
        taken, found = cells if taken is None else checkpointed(taken.unionByName(cells)), found + 1
    if found < nucleoli:
        raise ValueError(f"no place for {nucleoli} nucleoli in {most} draws")
    marked = body if taken is None else body.join(taken.withColumn("__in", F.lit(True)), ["ix", "iy"], "left")
    part = F.lit("nucleus") if taken is None else F.when(F.col("__in"), "nucleolus").otherwise("nucleus")
    return marked.select("slice", "ix", "iy", part.alias("part"))


def camera_noise(pixels: DataFrame, em_gain: float = 300.0, read_noise: float = 1.0, seed: int = 1, column: str = "photons") -> DataFrame:
    """Shot noise of a gain register and read noise, normal approximations, for long pixel tables (frame, ix, iy, photons)."""
    key = F.concat_ws(",", "frame", "ix", "iy")
    normal = lambda s: F.sqrt(-2 * F.ln(1 - uniform(key, f"{s}a{seed}"))) * F.cos(2 * math.pi * uniform(key, f"{s}b{seed}"))
    excess = math.sqrt(2 - 1 / em_gain)
    return pixels.withColumn("signal", F.greatest(F.col(column) + excess * F.sqrt(F.greatest(F.col(column), F.lit(0.0))) * normal("s") + read_noise * normal("r"), F.lit(0.0)))
