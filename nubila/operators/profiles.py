"""Radial profiles: contact ratios, distribution functions, histograms, normalisation and roll-up."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import interpolated, sphere_volume
from nubila.operators.spatial import crowded_ring_counts, range_join, ring_counts


def mean_profile(counts: DataFrame, column: str = "within", keys: Sequence[str] = ()) -> DataFrame:
    """Mean over points for each ring."""
    return counts.groupBy(*keys, "ring").agg(F.avg(column).alias("value"))


def contact_ratio(own: DataFrame, other: DataFrame, radius: float, step: float = 10.0, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean own-channel neighbours over mean other-channel neighbours around own points, for each radius.

    The point itself doesn't count; no other-channel neighbours give null.
    """
    mine = mean_profile(ring_counts(own, own, radius, step, axes, keys, same=True), keys=keys).withColumnRenamed("value", "own")
    cross = mean_profile(ring_counts(own, other, radius, step, axes, keys), keys=keys).withColumnRenamed("value", "other")
    return mine.join(cross, [*keys, "ring"]).select(*keys, "ring", (F.col("ring") * step).alias("r"), "own", "other", F.try_divide("own", "other").alias("ratio"))


def radial_distribution(left: DataFrame, right: DataFrame, radius: float, step: float = 10.0, same: bool = False, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean cumulative neighbours over the sphere's volume, for each radius."""
    mean = mean_profile(ring_counts(left, right, radius, step, axes, keys, same), keys=keys)
    r = F.col("ring") * step
    return mean.select(*keys, "ring", r.alias("r"), (F.col("value") / sphere_volume(r)).alias("rdf"))


def ripley_k(points: DataFrame, radius: float, area: float, step: float = 10.0, axes: Sequence[str] = ("x", "y"), keys: Sequence[str] = ()) -> DataFrame:
    """area / (n (n - 1)) times the ordered pairs within each radius."""
    pairs = ring_counts(points, points, radius, step, axes, keys, same=True).groupBy(*keys, "ring").agg(F.sum("within").alias("pairs"), F.count("*").alias("n"))
    return pairs.select(*keys, "ring", (F.col("ring") * step).alias("r"), F.try_divide(F.col("pairs") * area, (F.col("n") * (F.col("n") - 1)).cast("double")).alias("k"))


def ring_histogram(counts: DataFrame, column: str = "in_ring", keys: Sequence[str] = (), share: bool = False) -> DataFrame:
    """Points with each count 0..max in each ring, zeros included: keys, ring, k, freq (or its share of the ring)."""
    found = counts.groupBy(*keys, "ring", F.col(column).cast("long").alias("k")).agg(F.count("*").alias("freq"))
    every = found.groupBy(*keys, "ring").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("k"))).alias("k"))
    full = every.join(found, [*keys, "ring", "k"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return full.withColumn("freq", F.col("freq") / F.sum("freq").over(Window.partitionBy(*keys, "ring"))) if share else full


def expected_shell_counts(histogram: DataFrame, step: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """Expected count of each ring by bin midpoints, over the ring's annulus."""
    mean = histogram.groupBy(*keys, "ring").agg((F.sum(F.col("freq") * (F.col("k") + 0.5)) / F.sum("freq")).alias("expected"))
    outer = F.col("ring") * step
    return mean.withColumn("value", F.col("expected") / (math.pi * (outer * outer - (outer - step) * (outer - step))))


def centroid_profile(points: DataFrame, centroids: DataFrame, radius: float, step: float = 10.0, axes: Sequence[str] = ("x", "y"), subtract: int = 0) -> DataFrame:
    """Cumulative neighbours of each centroid (id, x, y, z) for each radius."""
    return ring_counts(centroids, points, radius, step, axes).withColumn("within", F.col("within") - subtract)


def axial_spread_profile(points: DataFrame, centroids: DataFrame, radius: float, step: float = 10.0, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Mean |dz| of the points in each ring around each centroid; rings without points have null."""
    pairs = range_join(centroids, points, radius, axes, more=("z",))
    ring = F.least(F.greatest(F.ceil(F.sqrt("d2") / step), F.lit(1)), F.lit(int(radius // step))).cast("int")
    found = pairs.groupBy(F.col("a_id").alias("id"), ring.alias("ring")).agg(F.avg(F.abs(F.col("b_z") - F.col("a_z"))).alias("dz"))
    every = centroids.select("id", F.explode(F.sequence(F.lit(1), F.lit(int(radius // step)))).alias("ring"))
    return every.join(found, ["id", "ring"], "left")


def ring_difference(profile: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Ring values of a cumulative profile, negatives as 0."""
    w = Window.partitionBy(*keys).orderBy("ring")
    return profile.withColumn("in_ring", F.greatest(F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)), F.lit(0)))


def min_max(profile: DataFrame, column: str = "value", keys: Sequence[str] = (), first: int = 20) -> DataFrame:
    """The first rings, scaled by the whole profile's limits; a constant profile gives null."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return profile.withColumn("scaled", F.try_divide(F.col(column) - lo, hi - lo)).where(F.col("ring") <= first)


def falling_segment(profile: DataFrame, column: str = "value", keys: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """The strictly decreasing run that follows the initial non-decreasing run, rings below the limit."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy("ring")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.lead(column).over(w)
    marked = profile.withColumn("__falls", (nxt < F.col(column)).cast("int")).withColumn("__begun", F.max("__falls").over(upto))
    marked = marked.withColumn("__ends", F.max(F.when((F.col("__begun") == 1) & (F.coalesce("__falls", F.lit(0)) == 0), 1).otherwise(0)).over(upto))
    return marked.where((F.col("__begun") == 1) & (F.col("__ends") == 0) & (F.col("ring") < limit)).drop("__falls", "__begun", "__ends")


def width_at(profile: DataFrame, column: str = "value", share: float = 0.2, step: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """Twice the first radius whose value is under a share of the maximum; null if none is."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    marked = profile.withColumn("__top", F.max(column).over(w))
    return marked.groupBy(*keys).agg((2 * step * F.min(F.when(F.col(column) < share * F.col("__top"), F.col("ring")))).alias("width"))


def scaled_by_max(profile: DataFrame, column: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return profile.withColumn("scaled", F.try_divide(F.col(column), F.max(column).over(w)))


def scaled_to_sum(spectrum: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spectrum.withColumn("scaled", F.try_divide(F.col(column), F.sum(column).over(w)))


def peak_statistic(profile: DataFrame, column: str = "value", keys: Sequence[str] = (), low: int = 80, high: int = 100) -> DataFrame:
    """Maximum over the mean of the far rings."""
    return profile.groupBy(*keys).agg(F.try_divide(F.max(column), F.avg(F.when(F.col("ring").between(low, high), F.col(column)))).alias("peak"))


def replicate_mean(profiles: DataFrame, column: str = "value", keys: Sequence[str] = ("condition",), position: str = "ring") -> DataFrame:
    """Mean over cells at each position, and how many cells have it."""
    return profiles.groupBy(*keys, position).agg(F.avg(column).alias("mean"), F.count(column).alias("cells"))


def calibration_update(real: DataFrame, simulated: DataFrame, factor: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per ring: ratio simulated / real, the factor divided by it, and the largest |ratio - 1| of all rings.

    Each table has ring and value; a ring without a real or simulated value keeps its factor.
    """
    r, s, f = (t.select(*keys, "ring", F.col("value").alias(n)) for t, n in ((real, "real"), (simulated, "simulated"), (factor, "factor")))
    joined = f.join(r, [*keys, "ring"], "left").join(s, [*keys, "ring"], "left").withColumn("ratio", F.try_divide("simulated", "real"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return joined.select(*keys, "ring", "ratio", F.coalesce(F.try_divide("factor", "ratio"), "factor").alias("factor"), F.max(F.abs(F.col("ratio") - 1)).over(w).alias("dif"))


def slice_occupancy(points: DataFrame, column: str = "z", width: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """Share of points and rounded midpoint of each slice."""
    n = points.groupBy(*keys, F.floor(F.col(column) / width).alias("slice")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return n.select(*keys, "slice", (F.col("n") / F.sum("n").over(w)).alias("share"), F.round((F.col("slice") + 0.5) * width).alias("middle"))


def interpolated_lookup(knots: DataFrame, x: str, y: str, low: float, high: float, step: float) -> DataFrame:
    """Linear values of a curve on an even grid; grid points outside the knots are left out."""
    w = Window.partitionBy(F.lit(0)).orderBy("x0")
    one = knots.groupBy(F.col(x).cast("double").alias("x0")).agg(F.avg(y).alias("y0"))
    spans = one.withColumn("x1", F.coalesce(F.lead("x0").over(w), F.col("x0"))).withColumn("y1", F.coalesce(F.lead("y0").over(w), F.col("y0")))
    last = F.col("x1") == F.col("x0")
    first_k, end_k = F.ceil((F.col("x0") - low) / step), F.when(last, F.floor((F.col("x1") - low) / step)).otherwise(F.ceil((F.col("x1") - low) / step) - 1)
    first_k, end_k = F.greatest(first_k, F.lit(0)), F.least(end_k, F.lit(math.floor((high - low) / step)))
    grid = spans.where(end_k >= first_k).withColumn("k", F.explode(F.sequence(first_k, end_k)))
    at = F.lit(low) + F.col("k") * step
    return grid.select(at.alias("x"), interpolated(at, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("y"))


def abundance(points: DataFrame, clusters: DataFrame, counts: DataFrame, keys: Sequence[str] = (), first: str = "C1", second: str = "C2") -> DataFrame:
    """Points of both channels and their ratio, clusters of both, and the mean neighbours of a point over the channel's points.

    points: keys, channel. clusters: keys, channel, one row each. counts: keys, channel, id, within (its largest for each point).
    """
    n = lambda c, name: F.count(F.when(F.col("channel") == c, 1)).alias(name)
    mean = lambda c, name: F.avg(F.when(F.col("channel") == c, F.col("within"))).alias(name)
    sizes = points.groupBy(*keys).agg(n(first, "n1"), n(second, "n2"))
    groups = clusters.groupBy(*keys).agg(n(first, "clusters1"), n(second, "clusters2"))
    around = counts.groupBy(*keys).agg(mean(first, "within1"), mean(second, "within2"))
    joined = sizes.join(groups, list(keys), "left").join(around, list(keys), "left") if keys else sizes.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(around))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b).cast("double"))
    return joined.select(*keys, "n1", "n2", share("n1", "n2").alias("ratio"), F.coalesce("clusters1", F.lit(0)).alias("clusters1"), F.coalesce("clusters2", F.lit(0)).alias("clusters2"), share("within1", "n1").alias("surround1"), share("within2", "n2").alias("surround2"))


def empirical_parameters(points: DataFrame, bands: DataFrame, box: DataFrame, size: float = 50.0, radius: float = 200.0, step: float = 10.0, z_stretch: float = 1.5) -> DataFrame:
    """What a simulation needs of a real cell, in one table (kind, step, k, value).

    profile: points per cell of each band from 1 (k is null). ring: how many points have k neighbours, themselves included, in each
    ring. z: the axial stretch of each ring. origin: the grid's corner, x as step 0 and y as step 1.
    """
    from nubila.operators import raster

    null = F.lit(None).cast("long")
    density = raster.band_profile(raster.on_grid(points, box, size), bands).where("band >= 1")
    profile = density.select(F.lit("profile").alias("kind"), F.col("band").cast("long").alias("step"), null.alias("k"), F.col("density").alias("value"))
    rings = ring_histogram(crowded_ring_counts(points, points, radius, step, ("x", "y")))
    histogram = rings.select(F.lit("ring").alias("kind"), F.col("ring").cast("long").alias("step"), F.col("k").cast("long").alias("k"), F.col("freq").cast("double").alias("value"))
    stretch = points.sparkSession.range(1, int(radius // step) + 1).select(F.lit("z").alias("kind"), F.col("id").alias("step"), null.alias("k"), F.lit(z_stretch).alias("value"))
    corner = box.select(F.lit("origin").alias("kind"), F.posexplode(F.array("x0", "y0")).alias("step", "value")).select("kind", F.col("step").cast("long").alias("step"), null.alias("k"), "value")
    return profile.unionByName(histogram).unionByName(stretch).unionByName(corner)


def decay_segments(own: DataFrame, other: DataFrame, radius: float = 1000.0, step: float = 10.0, keys: Sequence[str] = (), first: int = 20) -> DataFrame:
    """The falling part of the scaled contact ratio: keys, ring, r, value."""
    ratio = contact_ratio(own, other, radius, step, keys).select(*keys, "ring", F.col("ratio").alias("value"))
    from nubila.operators.filters import drop_unstable_start

    scaled = min_max(drop_unstable_start(ratio, "value", keys), "value", keys, first).select(*keys, "ring", F.col("scaled").alias("value"))
    return falling_segment(scaled, "value", keys, first).withColumn("r", F.col("ring") * step)


def decay_constants(own: DataFrame, other: DataFrame, radius: float = 1000.0, step: float = 10.0, keys: Sequence[str] = (), first: int = 20) -> DataFrame:
    """a and b of the exponential through the falling part of the contact ratio: keys, a, b."""
    from nubila.operators.fitting import exponential_fits

    return exponential_fits(decay_segments(own, other, radius, step, keys, first), keys, "r", "value")


def ground_truth_width(histogram: DataFrame, step: float = 10.0, share: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Width of a domain: twice the first radius where the expected density, less its least, is under a share of its largest."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    density = expected_shell_counts(histogram, step, keys)
    return width_at(density.withColumn("value", F.col("value") - F.min("value").over(w)), "value", share, step, keys)
