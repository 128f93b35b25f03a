"""Connected components, density-based clustering and per-cluster geometry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed
from nubila.operators.cells import density_clusters, numbered_clusters


def dbscan(points: DataFrame, eps: float, min_samples: int = 8, axes: Sequence[str] = ("x", "y"), first_label: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """points with cluster_label: noise -1, clusters numbered by their smallest core id, for each value of the keys.

    A core point has min_samples points within eps, itself included; a border point takes the smallest of its clusters, so the
    result is that of a scan in id order whatever the partitioning. Points without a coordinate are noise.
    """
    clusters = checkpointed(density_clusters(points, eps, min_samples, axes, keys))
    labelled = numbered_clusters(clusters, keys, first_label)
    return points.join(labelled, [*keys, "id"], "left").withColumn("cluster_label", F.coalesce("cluster_label", F.lit(-1)))


def cluster_sizes(clustered: DataFrame, keys: Sequence[str] = ("cluster_label",)) -> DataFrame:
    """Per cluster: n, centroid, bounding-box sizes (mean of the axis ranges) in two and three dimensions."""
    rows = clustered.where("cluster_label <> -1") if "cluster_label" in keys else clustered
    span = {a: F.max(a) - F.min(a) for a in ("x", "y", "z")}
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
        ((span["x"] + span["y"]) / 2).alias("bb_2D"), ((span["x"] + span["y"] + span["z"]) / 3).alias("bb_3D"),
    )


def adaptive_radius(density: F.Column, coef: float, exp: float) -> F.Column:
    """Clustering radius by the calibrated power law of density."""
    return coef * F.pow(density, exp)


def kmeans(points: DataFrame, k: int = 10, axes: Sequence[str] = ("x", "y", "z"), seed: int = 0) -> DataFrame:
    """points with kmeans_label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(axes), outputCol="__v").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="kmeans_label").fit(vectors).transform(vectors).drop("__v")


def sparse_half(clustered: DataFrame, label: str = "kmeans_label") -> DataFrame:
    """Clusters with box density (points over the box volume), and whether each is in the lower round(n / 2) of densities."""
    span = lambda a: F.max(a) - F.min(a)
    boxes = clustered.groupBy(label).agg(F.count("*").alias("n"), (span("x") * span("y") * span("z")).alias("volume"))
    dense = boxes.withColumn("density", F.try_divide(F.col("n").cast("double"), F.col("volume")))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy("density", label))
    return dense.withColumn("sparse", rank <= F.round(F.count("*").over(everything) / 2))


def _with_means(rows: DataFrame, means: DataFrame, label: str, axes: Sequence[str]) -> DataFrame:
    """rows beside one array of all means, of which there are few: `label` and the axes, as structs."""
    whole = means.agg(F.collect_list(F.struct(F.col(label).alias("label"), *[F.col(a).alias(a) for a in axes])).alias("__means"))
    return rows.crossJoin(F.broadcast(whole))


def _nearest_mean(axes: Sequence[str]) -> F.Column:
    """d2 and label of the nearest of the row's means; of equal ones the least label."""
    d2 = lambda m: sum(((F.col(a) - m[a]) * (F.col(a) - m[a]) for a in axes), F.lit(0.0))
    return F.array_min(F.transform("__means", lambda m: F.struct(d2(m).alias("d2"), m["label"].alias("label"))))


#: Means of k-means at most: each row is compared with all of them.
MEANS = 10_000


def lloyd(points: DataFrame, seeds: DataFrame, steps: int = 10, axes: Sequence[str] = ("x", "y", "z"), label: str = "kmeans_label") -> DataFrame:
    """points with the label of the nearest mean after so many steps from the seeds (label and axes), which number MEANS at most.

    Each step gives every point to the nearest mean and then moves the means to their points; a mean without points stays. One row
    holds all means, so points are neither joined nor shuffled but for the sums of each mean.
    """
    means = checkpointed(seeds.select(F.col(label).cast("int").alias(label), *[F.col(a).cast("double").alias(a) for a in axes]))
    if means.count() > MEANS:
        raise ValueError(f"more than {MEANS} means")
    rows = points.select(*[F.col(a).cast("double").alias(a) for a in axes])
    for _ in range(steps):
        given = _with_means(rows, means, label, axes).select(*axes, _nearest_mean(axes)["label"].alias(label))
        moved = given.groupBy(label).agg(*[F.avg(a).alias(f"__{a}") for a in axes])
        means = checkpointed(means.join(moved, label, "left").select(label, *[F.coalesce(f"__{a}", a).alias(a) for a in axes]))
    return _with_means(points, means, label, axes).withColumn(label, _nearest_mean(axes)["label"]).drop("__means")


def misplaced(clustered: DataFrame, label: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points, clusters, and how many points lie clearly nearer to another cluster's mean than to their own."""
    means = clustered.groupBy(label).agg(*[F.avg(a).alias(a) for a in axes])
    each = _with_means(clustered, means, label, axes)
    own = F.filter("__means", lambda m: m["label"] == F.col(label))[0]
    d2 = sum(((F.col(a) - own[a]) * (F.col(a) - own[a]) for a in axes), F.lit(0.0))
    rows = each.select(label, d2.alias("own"), _nearest_mean(axes)["d2"].alias("least"))
    return rows.agg(F.count("*").alias("points"), F.count_distinct(label).alias("clusters"), F.count(F.when(F.sqrt("own") > F.sqrt("least") * 1.1 + 1, 1)).alias("misplaced"))


def segment_by_clusters(points: DataFrame, label: str, flip: float, seed: int = 1) -> DataFrame:
    """points with class 1 in the denser half of the clusters, else 0, each flipped with a probability."""
    from nubila.operators.filters import flip_class

    half = sparse_half(points, label).select(F.col(label).alias("__label"), F.when(F.col("sparse"), 0).otherwise(1).alias("class"))
    return flip_class(points.join(half, F.col(label) == F.col("__label")).drop("__label"), "class", flip, seed)


def segment_by_neighbours(points: DataFrame, cutoff: float, flip: float, seed: int = 1) -> DataFrame:
    """id and class: whether the mean distance to the nearest neighbours exceeds the cut-off, each flipped with a probability."""
    from nubila.operators.filters import flip_class, threshold_class
    from nubila.operators.spatial import adaptive_mean_nearest

    return flip_class(threshold_class(adaptive_mean_nearest(points), "distance", cutoff).select("id", "class"), "class", flip, seed)


# --- hulls -----------------------------------------------------------------------------------------------------------------


def hull_2d(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise; collinear points give fewer than three."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def area_2d(points: np.ndarray) -> float:
    """Area of the convex hull."""
    h = hull_2d(points)
    if len(h) < 3:
        return 0.0
    x, y = h[:, 0], h[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def hull_3d(points: np.ndarray) -> tuple[float, np.ndarray]:
    """Volume and vertices of the convex hull; coplanar points give 0 and none.

    Every face keeps the points that it sees. The farthest of a face's points becomes a corner: the faces that see it go, new ones
    close the gap around it, and the points of those that went are dealt to the new ones. Points inside are dropped at once, so the
    steps are the hull's corners, each over arrays.
    """
    p = np.unique(points, axis=0)
    none = 0.0, np.empty((0, 3))
    if len(p) < 4:
        return none
    scale = float(np.ptp(p, axis=0).max()) or 1.0
    a, b = 0, int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    c = int(np.argmax((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(axis=1)))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if np.linalg.norm(normal) < 1e-12 * scale**2 or abs((p[d] - p[a]) @ normal) < 1e-9 * scale * np.linalg.norm(normal):
        return none
    middle = p[[a, b, c, d]].mean(axis=0)

    def outward(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corners of faces, turned so that their normals point away from the middle, and the normals."""
        normals = np.cross(p[corners[:, 1]] - p[corners[:, 0]], p[corners[:, 2]] - p[corners[:, 0]])
        inward = ((p[corners[:, 0]] - middle) * normals).sum(axis=1) < 0
        return np.where(inward[:, None], corners[:, [0, 2, 1]], corners), np.where(inward[:, None], -normals, normals)

    tolerance = 1e-10 * scale**3
    faces, normals = outward(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))

    def dealt(which: np.ndarray, faces: np.ndarray, normals: np.ndarray) -> list[np.ndarray]:
        """For each face those of the points that it sees farthest, the farthest last."""
        best, face = np.full(len(which), tolerance), np.full(len(which), -1)
        for k, (corner, n) in enumerate(zip(faces[:, 0], normals, strict=True)):
            height = (p[which] - p[corner]) @ n
            best, face = np.where(height > best, height, best), np.where(height > best, k, face)
        order = np.argsort(best, kind="stable")
        return [which[order][face[order] == k] for k in range(len(faces))]

    seen_by = dealt(np.arange(len(p)), faces, normals)
    while waiting := [k for k, seen in enumerate(seen_by) if len(seen)]:
        tip = int(seen_by[waiting[0]][-1])
        visible = ((p[tip] - p[faces[:, 0]]) * normals).sum(axis=1) > tolerance
        edges = {(f[x], f[y]) for f in faces[visible].tolist() for x, y in ((0, 1), (1, 2), (2, 0))}
        more, more_normals = outward(np.array([(u, v, tip) for u, v in edges if (v, u) not in edges]))
        loose = np.concatenate([seen_by[k] for k in np.flatnonzero(visible)])
        seen_by = [seen_by[k] for k in np.flatnonzero(~visible)] + dealt(loose[loose != tip], more, more_normals)
        faces, normals = np.concatenate([faces[~visible], more]), np.concatenate([normals[~visible], more_normals])
    volume = np.abs(((p[faces[:, 0]] - middle) * normals).sum(axis=1)).sum() / 6
    return float(volume), p[np.unique(faces)]


def cluster_geometry(clustered: DataFrame, keys: Sequence[str] = ("cluster_label",), least: int = 4) -> DataFrame:
    """Per cluster: n, hull and box sizes, densities, hull vertices and their centroid.

    With fewer than `least` points, or when a hull has no area or volume, all sizes and densities are 0. Noise is left out. Each
    input partition's share of a cluster is first reduced to its hulls' corners, which hold the corners of the whole, so a cluster's
    points never meet in one task.
    """
    rows = clustered.where("cluster_label <> -1") if "cluster_label" in keys else clustered
    kinds = dict(rows.dtypes)
    names = list(keys)
    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(dtype=float)
        whole = p[~np.isnan(p).any(axis=1)]
        volume, solid = hull_3d(whole)
        solid = solid if volume > 0 else np.unique(whole, axis=0)
        flat = hull_2d(whole[:, :2]) if len(whole) else np.empty((0, 2))
        row = {k: pdf[k].iloc[0] for k in names} | {"n": len(pdf), "known": len(whole), "flat": flat.reshape(-1).tolist(), "solid": solid.reshape(-1).tolist()}
        return pd.DataFrame([row])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = lambda c, d: np.concatenate([np.array(v, dtype=float) for v in pdf[c]]).reshape(-1, d)
        p, n, known = corners("solid", 3), int(pdf["n"].sum()), int(pdf["known"].sum())
        flat, (volume, tops) = area_2d(corners("flat", 2)), hull_3d(p)
        sound = known >= least and flat > 0 and volume > 0
        span = np.ptp(p, axis=0) if len(p) else np.zeros(3)
        point = lambda v: dict(zip("xyz", map(float, v), strict=True))
        row = {k: pdf[k].iloc[0] for k in names} | {
            "n": n, "hull_2D": flat if sound else 0.0, "hull_3D": volume if sound else 0.0, "bb_2D": float(span[:2].mean()) if sound else 0.0, "bb_3D": float(span.mean()) if sound else 0.0,
            "density_2D": known / flat if sound else 0.0, "density_3D": known / volume if sound else 0.0, "centroid": point(tops.mean(axis=0)) if sound else None, "vertices": [point(v) for v in tops] if sound else [],
        }
        return pd.DataFrame([row])

    parted = rows.select(*keys, "x", "y", "z", F.spark_partition_id().alias("__part"))
    partial = parted.groupBy(*keys, "__part").applyInPandas(reduced, f"{typed}, n long, known long, flat array<double>, solid array<double>")
    return partial.groupBy(*keys).applyInPandas(one, f"{typed}, n long, hull_2D double, hull_3D double, bb_2D double, bb_3D double, density_2D double, density_3D double, centroid struct<x:double,y:double,z:double>, vertices array<struct<x:double,y:double,z:double>>")
