"""Curve fits, resampling and calibration of the clustering radius."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed, checkpoints_dropped
from nubila.operators.cells import density_clusters
from nubila.operators.cluster import cluster_geometry, cluster_sizes, dbscan
from nubila.operators.graph import connected_components, spanning_forest
from nubila.operators.spatial import most_pairs, range_join

#: Cost where no cluster is found.
NO_CLUSTER = 99999.0
GOLDEN = (3 - math.sqrt(5)) / 2
#: Pairs of points that a search may store; with more it clusters the cells of each radius.
PAIRS = 5_000_000


def power_law(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """coef, exp and R2 of y = coef x^exp, by regression of the logarithms; rows that aren't positive are left out."""
    lx, ly = F.log10(x), F.log10(y)
    fit = df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys)
    return fit.agg(F.pow(F.lit(10.0), F.regr_intercept(ly, lx)).alias("coef"), F.regr_slope(ly, lx).alias("exp"), F.regr_r2(ly, lx).alias("r2"))


def fit_exponential(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of y = a e^(b x) by damped least squares from a log-linear start."""
    good = y > 0
    b, a = (np.polyfit(x[good], np.log(y[good]), 1) if good.sum() > 1 else (0.0, math.log(max(float(y.mean()), 1e-9))))
    p, damp = np.array([math.exp(min(a, 50)), b]), 1e-3
    cost = lambda q: float(((q[0] * np.exp(np.clip(q[1] * x, -50, 50)) - y) ** 2).sum())
    for _ in range(200):
        e = np.exp(np.clip(p[1] * x, -50, 50))
        jac, res = np.stack([e, p[0] * x * e], axis=1), p[0] * e - y
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), -jac.T @ res)
        if cost(p + step) < cost(p):
            p, damp = p + step, damp / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1])


def _grouped(df: DataFrame, keys: Sequence[str], columns: Sequence[str], schema: str, function: Callable) -> DataFrame:
    kinds, names = dict(df.dtypes), list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf.dropna(subset=list(columns)).sort_values(columns[0]))
        for k in reversed(names):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(one, ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema]))


def exponential_fits(profile: DataFrame, keys: Sequence[str], x: str = "ring", y: str = "value") -> DataFrame:
    """a and b of a one-term exponential for each group; fewer than two points give nulls."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = fit_exponential(pdf[x].to_numpy(float), pdf[y].to_numpy(float)) if len(pdf) > 1 else (None, None)
        return pd.DataFrame({"a": pd.Series([a], dtype=float), "b": pd.Series([b], dtype=float)})

    return _grouped(profile, keys, (x, y), "a double, b double", fit)


def resample(values: np.ndarray, up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Rational resampling by a windowed-sinc filter: zero stuffing, low pass, decimation; the delay is removed."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(n / widest) * np.kaiser(len(n), beta)
    h *= up / h.sum()
    stuffed = np.zeros(len(values) * up)
    stuffed[::up] = values
    return np.convolve(stuffed, h)[half * widest :][: len(stuffed)][::down][: -(-len(values) * up // down)]


def resampled(profile: DataFrame, keys: Sequence[str], points: int = 100, y: str = "value", x: str = "ring") -> DataFrame:
    """Each profile at a fixed number of points: position 1..points, value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = resample(pdf[y].to_numpy(float), points, max(len(pdf), 1))[:points] if len(pdf) else np.empty(0)
        return pd.DataFrame({"position": np.arange(1, len(v) + 1, dtype="int32"), "value": v})

    return _grouped(profile, keys, (x, y), "position int, value double", run)


def _sizes(radii: RadiusForest | RadiusCells, eps: float, metric: str) -> DataFrame:
    found = radii.points.join(radii.clusters(eps), "id")
    rows = cluster_sizes(found, ["component"]) if metric.startswith("bb") else cluster_geometry(found, ["component"])
    return rows.select("component", metric)


class RadiusForest:
    """Density clusters of points (id, axes) at any radius up to `high`, from one join of the points.

    Two points belong together from the radius on at which both are core points and within reach of each other: the greatest of
    their core distances (to the min_samples-th nearest, itself included) and their own distance. The minimum spanning forest of
    these links has the same components at every radius, so a radius is a cut of the forest. A point that is no core point at a
    radius has all its neighbours within it among its min_samples - 1 nearest, which are kept for the border points.

    Work and space grow with the pairs of points within `high`, so with the square of the density; RadiusCells has none.
    """

    def __init__(self, points: DataFrame, high: float, min_samples: int = 8, axes: Sequence[str] = ("x", "y")):
        self.points, self.high, self.least = points, float(high), min_samples
        pairs = checkpointed(range_join(points, points, high, axes).select("a_id", "b_id", "d2"))
        place = F.row_number().over(Window.partitionBy("a_id").orderBy("d2", "b_id"))
        # The rank's limit is applied by every task before the shuffle.
        self.near = checkpointed(pairs.withColumn("rank", place).where(F.col("rank") <= min_samples))
        self.core = checkpointed(self.near.where(F.col("rank") == min_samples).select(F.col("a_id").alias("id"), F.col("d2").alias("core2")))
        a, b = (self.core.select(F.col("id").alias(f"{s}_id"), F.col("core2").alias(f"{s}_core")) for s in "ab")
        links = pairs.where("a_id < b_id").join(a, "a_id").join(b, "b_id")
        self.forest = spanning_forest(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.greatest("a_core", "b_core", "d2").alias("w")))

    def clusters(self, eps: float) -> DataFrame:
        """(id, component) of the points in clusters at a radius, as density_clusters gives them."""
        if eps > self.high:
            raise ValueError(f"the forest reaches to {self.high}")
        square = float(eps) * abs(float(eps))  # a negative radius holds nothing
        core = self.core.where(F.col("core2") <= square).select("id")
        parts = checkpointed(connected_components(core, self.forest.where(F.col("w") <= square)))
        loose = self.near.where(F.col("d2") <= square).join(core.withColumnRenamed("id", "a_id"), "a_id", "left_anti")
        border = loose.join(parts.withColumnRenamed("id", "b_id"), "b_id").groupBy(F.col("a_id").alias("id")).agg(F.min("component").alias("component"))
        return parts.union(border)

    def sizes(self, eps: float, metric: str = "bb_2D") -> DataFrame:
        """component and the metric of each cluster at a radius."""
        return _sizes(self, eps, metric)

    def signed_cost(self, eps: float, target: float, metric: str = "bb_2D") -> float:
        """Mean cluster size less the target; -100 where no cluster is found."""
        value = self.sizes(eps, metric).agg(F.avg(metric).alias("v")).first()["v"]
        return -100.0 if value is None else float(value) - target


class RadiusCells:
    """Density clusters of points (id, x, y, z) at any radius, each over cells: no pairs of points are made or stored."""

    high = math.inf

    def __init__(self, points: DataFrame, min_samples: int = 8):
        self.points, self.least = checkpointed(points.select("id", "x", "y", "z")), min_samples

    def clusters(self, eps: float) -> DataFrame:
        return density_clusters(self.points, eps, self.least, ("x", "y"))

    def sizes(self, eps: float, metric: str = "bb_2D") -> DataFrame:
        """component and the metric of each cluster at a radius."""
        return _sizes(self, eps, metric)

    def signed_cost(self, eps: float, target: float, metric: str = "bb_2D") -> float:
        """Mean cluster size less the target; -100 where no cluster is found. What the step stores is deleted at its end."""
        with checkpoints_dropped(self.points.sparkSession):
            value = self.sizes(eps, metric).agg(F.avg(metric).alias("v")).first()["v"]
        return -100.0 if value is None else float(value) - target


def all_radii(points: DataFrame, high: float, min_samples: int = 8) -> RadiusForest | RadiusCells:
    """The forest where the pairs within `high` are few, whatever the input; else cells for each radius. Both give the same clusters."""
    few = most_pairs(points, high, ("x", "y")) <= PAIRS
    return RadiusForest(points, high, min_samples) if few else RadiusCells(points, min_samples)


def eps_grid_cost(points: DataFrame, radii: Sequence[float], target: float, min_samples: int = 8, metric: str = "bb_2D") -> DataFrame:
    """|mean cluster size - target| for each radius; 99999 where no cluster is found."""
    found, out = all_radii(points, max(radii), min_samples), None
    for eps in radii:
        one = found.sizes(eps, metric).agg(F.count("*").alias("clusters"), F.coalesce(F.abs(F.avg(metric) - target), F.lit(NO_CLUSTER)).alias("cost")).select(F.lit(float(eps)).alias("eps"), "clusters", "cost")
        out = one if out is None else out.unionByName(one)
    return out


def sizes_at(points: DataFrame, eps: float, min_samples: int, metric: str) -> DataFrame:
    clustered = dbscan(points, eps, min_samples)
    return (cluster_sizes(clustered) if metric.startswith("bb") else cluster_geometry(clustered)).select("cluster_label", metric)


def bounded_minimum(cost: Callable[[float], float], low: float, high: float, tolerance: float = 1.0, most: int = 30) -> tuple[float, float]:
    """Place and value of the least cost found by golden-section search in an interval."""
    a, b = low, high
    x, y = a + GOLDEN * (b - a), b - GOLDEN * (b - a)
    fx, fy, k = cost(x), cost(y), 2
    while b - a > tolerance and k < most:
        if fx <= fy:
            b, y, fy = y, x, fx
            x = a + GOLDEN * (b - a)
            fx = cost(x)
        else:
            a, x, fx = x, y, fy
            y = b - GOLDEN * (b - a)
            fy = cost(y)
        k += 1
    return (x, fx) if fx <= fy else (y, fy)


def halving_search(cost: Callable[[float], float], start: float = 30.0, step: float = 5.0, accept: float = 1.3, most: int = 20) -> tuple[float, float, int]:
    """Radius, signed cost and steps: moves against the cost's sign, halving the step whenever the sign turns."""
    eps, flips, sign, value, k = start, 0, 0, float("inf"), 0
    while k < most:
        k += 1
        value = cost(eps)
        if abs(value) <= accept or k == most:
            break
        now = 1 if value > 0 else -1
        flips += bool(sign) and now != sign
        sign = now
        eps -= now * step / 2**flips
    return eps, value, k


def signed_cost(points: DataFrame, eps: float, target: float, min_samples: int = 8, metric: str = "bb_2D") -> float:
    """Mean cluster size less the target; -100 where no cluster is found."""
    value = sizes_at(points, eps, min_samples, metric).agg(F.avg(metric).alias("v")).first()["v"]
    return -100.0 if value is None else float(value) - target


def find_eps(points: DataFrame, target: float, low: float = 10.0, high: float = 200.0, min_samples: int = 8, metric: str = "bb_2D", tolerance: float = 1.0) -> tuple[float, float]:
    """Radius in [low, high] whose mean cluster size comes nearest to the target, and its cost."""
    with checkpoints_dropped(points.sparkSession):
        found = all_radii(points, high, min_samples)

        def cost(eps: float) -> float:
            value = found.signed_cost(eps, target, metric)
            return NO_CLUSTER if value == -100.0 else abs(value)

        return bounded_minimum(cost, low, high, tolerance)


def with_targets(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of each fraction with the target of the same fraction, whatever their order."""
    key = lambda df: df.withColumn("__f", F.round(F.col("fraction") * 1e6).cast("long"))
    return key(samples).join(key(targets).drop("fraction"), "__f").drop("__f")


def chained_radii(samples: DataFrame, targets: dict[float, float], start: float = 30.0, back: float = 2.0, reach: float = 2.0, min_samples: int = 8, **search) -> DataFrame:
    """fraction, eps, cost, steps: step halving for each fraction, dense first; each search starts at the last result less `back`.

    Where a fraction has a forest, it reaches to `reach` times where the search starts, and is grown to as much beyond a step that
    leaves it.
    """
    rows = []
    for fraction, target in sorted(targets.items(), reverse=True):
        with checkpoints_dropped(samples.sparkSession):
            part = samples.where(F.abs(F.col("fraction") - fraction) < 1e-9)
            found = [all_radii(part, reach * start, min_samples)]

            def cost(eps: float) -> float:
                if eps > found[-1].high:  # noqa: B023
                    found.append(all_radii(part, reach * eps, min_samples))  # noqa: B023
                return found[-1].signed_cost(eps, target)  # noqa: B023

            eps, value, steps = halving_search(cost, start, **search)
        rows.append((float(fraction), float(eps), float(value), int(steps)))
        start = max(eps - back, 1.0)
    return samples.sparkSession.createDataFrame(rows, "fraction double, eps double, cost double, steps int")


def calibrated_power_law(samples: DataFrame, targets: dict[float, float], area: float, low: float = 10.0, high: float = 200.0, tolerance: float = 2.0) -> DataFrame:
    """Radius for each fraction (paired with its target by fraction), its density, and the power law through them."""
    rows = []
    for fraction, target in sorted(targets.items()):
        part = samples.where(F.abs(F.col("fraction") - fraction) < 1e-9)
        eps, cost = find_eps(part, target, low, high, tolerance=tolerance)
        rows.append((float(fraction), part.count() / area, float(eps), float(cost)))
    found = samples.sparkSession.createDataFrame(rows, "fraction double, density double, eps double, cost double")
    return power_law(found.where(F.col("cost") < NO_CLUSTER), "density", "eps")


def until_close(run: Callable[[int], float], limit: float = 0.3, most: int = 10) -> tuple[int, float]:
    """Calls run(iteration) until what it returns is at most the limit; iterations done and the last value."""
    value, k = float("inf"), 0
    while k < most and value > limit:
        k += 1
        value = run(k)
    return k, value


def calibrated_factors(simulate: Callable[[DataFrame], DataFrame], real: DataFrame, factor: DataFrame, limit: float = 0.3, most: int = 10) -> tuple[DataFrame, int]:
    """Factors (ring, factor, dif) that bring simulate(factors) within the limit of the real profile, and the rounds it took.

    In every round each ring's factor is divided by the ratio of the simulated to the real value; dif is the largest |ratio - 1| of the
    round. It ends when that is at most the limit, or after `most` rounds.
    """
    from nubila.operators.profiles import calibration_update

    now = [factor.select("ring", "factor")]

    def one(_: int) -> float:
        held = now[0].select("ring", F.col("factor").alias("value"))
        now[0] = checkpointed(calibration_update(real, simulate(held), held).select("ring", "factor", "dif"))
        worst = now[0].agg(F.max("dif").alias("dif")).first()["dif"]
        return float("inf") if worst is None else float(worst)

    rounds, _ = until_close(one, limit, most)
    return now[0], rounds
