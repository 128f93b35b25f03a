"""Components, spanning forests, cell-graph density clusters and cuts of the forest, against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import sequential_dbscan

from nubila.functions import core
from nubila.operators import cells, cluster, fitting, graph


def roots(n, links):
    first = list(range(n))

    def top(v):
        while first[v] != v:
            v = first[v]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        first[max(a, b)] = min(a, b)
    return [top(v) for v in range(n)]


def graphs():
    rng = np.random.default_rng(1)
    yield 60, [(i, i + 1) for i in range(59)]
    yield 50, [(0, i) for i in range(1, 50)] + [(49, 49)]
    yield 80, [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)]
    yield 5, []


@pytest.mark.parametrize("residual", [0, 50_000])
def test_components_by_contraction(spark, monkeypatch, residual):
    monkeypatch.setattr(graph, "RESIDUAL", residual)
    monkeypatch.setattr(core, "HOT_LEAST", 3)
    for n, links in graphs():
        vertices, edges = spark.range(n), spark.createDataFrame(links, "a long, b long")
        got = {r["id"]: r["component"] for r in graph.connected_components(vertices, edges).collect()}
        assert [got[v] for v in range(n)] == roots(n, links)
        if residual:
            named = lambda c: F.struct((F.lit(1000) - F.col(c)).alias("k"), F.col(c).cast("string").alias("s"))
            found = graph.connected_components(vertices.select(named("id").alias("id")), edges.select(named("a").alias("a"), named("b").alias("b"))).collect()
            largest = {v: max(u for u in range(n) if roots(n, links)[u] == roots(n, links)[v]) for v in range(n)}
            assert {int(r["id"]["s"]): int(r["component"]["s"]) for r in found} == largest


@pytest.mark.parametrize("residual", [0, 20, 50_000])
def test_spanning_forest_equals_kruskal(spark, monkeypatch, residual):
    monkeypatch.setattr(graph, "RESIDUAL", residual)
    rng = np.random.default_rng(2)
    for n, m, kinds in ((40, 120, 6), (30, 20, 100), (3, 0, 1)):
        links = [(*map(int, rng.integers(0, n, 2)), float(rng.integers(0, kinds))) for _ in range(m)]
        first, want = list(range(n)), set()

        def top(v):
            while first[v] != v:  # noqa: B023
                v = first[v]  # noqa: B023
            return v

        for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in links if a != b}):
            if top(a) != top(b):
                first[top(a)] = top(b)
                want.add((a, b, w))
        assert {tuple(r) for r in graph.spanning_forest(spark.createDataFrame(links, "a long, b long, w double")).collect()} == want


def clumps(kind):
    rng = np.random.default_rng(kind)
    p = np.concatenate([rng.normal(rng.uniform(0, 200, 2), rng.choice([2, 5, 20]), (40, 2)) for _ in range(8)])
    if kind % 3 == 1:
        p = np.round(p)  # ties and points at exactly the radius
    return np.concatenate([p, np.repeat(p[:20], 10, axis=0)]) if kind % 3 == 2 else p


def frame(spark, p, **more):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, " + ", ".join(f"{a} double" for a in "xyz"[: p.shape[1]])).withColumns({k: F.lit(v) for k, v in more.items()}).repartition(5)


@pytest.mark.parametrize("kind, eps, least", [(0, 3.0, 3), (1, 5.0, 8), (2, 5.0, 8), (4, 3.0, 5)])
def test_dbscan_of_clumps(spark, monkeypatch, kind, eps, least):
    monkeypatch.setattr(cells, "SMALL", 2)
    monkeypatch.setattr(cells, "PART", 7)
    monkeypatch.setattr(core, "HOT_LEAST", 5)
    p = clumps(kind)
    got = {r["id"]: r["cluster_label"] for r in cluster.dbscan(frame(spark, p), eps, least).collect()}
    assert [got[i] for i in range(len(p))] == sequential_dbscan(p, eps, least).tolist()


def test_dbscan_in_three_dimensions_and_by_keys(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(c, 4, (30, 3)) for c in rng.uniform(0, 60, (6, 3))])
    both = frame(spark, p, cell_id=1).unionByName(frame(spark, p + 1000, cell_id=2)).withColumn("cluster", F.lit("own"))
    got = cluster.dbscan(both, 6.0, 5, ("x", "y", "z"), keys=["cell_id"]).collect()
    want = sequential_dbscan(p, 6.0, 5).tolist()
    for key in (1, 2):
        found = {r["id"]: r["cluster_label"] for r in got if r["cell_id"] == key}
        assert [found[i] for i in range(len(p))] == want
    assert {r["cluster"] for r in got} == {"own"}


def test_dbscan_edges(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    assert cluster.dbscan(none, 5.0).count() == 0
    odd = spark.createDataFrame([(1, None, 0.0), (2, 1.0, None), (3, 1.0, 1.0), (4, 1.0, 1.0), (5, 4.0, 5.0)], "id long, x double, y double")
    assert {r["id"]: r["cluster_label"] for r in cluster.dbscan(odd, 5.0, 3).collect()} == {1: -1, 2: -1, 3: 0, 4: 0, 5: 0}


def test_a_clump_inside_the_radius_makes_no_pairs(spark):
    """A million points within the radius, and as many in a neighbouring cell: pairs would be 10^12."""
    n = 1_000_000
    where = lambda at, k: spark.range(k * n, k * n + n, 1, 8).select("id", (F.lit(at) + F.rand(1 + k) * 3).alias("x"), (F.rand(9 + k) * 3).alias("y"))
    points = where(0.0, 0).union(where(9.0, 1)).union(spark.createDataFrame([(2 * n, 500.0, 0.0), (2 * n + 1, 15.5, 1.0)], "id long, x double, y double"))
    began = time.time()
    found = {r["cluster_label"]: r["count"] for r in cluster.dbscan(points, 10.0).groupBy("cluster_label").count().collect()}
    assert found == {0: 2 * n + 1, -1: 1} and time.time() - began < 120


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_cuts_of_the_forest_are_the_clusters(spark, kind):
    p = clumps(kind)
    df = frame(spark, p)
    forest = fitting.RadiusForest(df, 9.0, 5)
    for eps in (1.0, 2.5, 5.0, 9.0):
        got = {r["id"]: r["component"] for r in forest.clusters(eps).collect()}
        want = sequential_dbscan(p, eps, 5)
        near = [(((p - q) ** 2).sum(axis=1) <= eps * eps).sum() for q in p]
        first = {k: min(i for i in range(len(p)) if want[i] == k and near[i] >= 5) for k in range(want.max() + 1)}
        assert got == {i: first[k] for i, k in enumerate(want.tolist()) if k >= 0}, eps
    with pytest.raises(ValueError, match="reaches"):
        forest.clusters(9.5)


def test_searches_run_to_their_end(spark):
    """Both searches against the same searches over sequential clustering, to full tolerance and steps."""
    p = clumps(0)
    df = frame(spark, p, z=0.0)

    def signed(eps):
        k = sequential_dbscan(p, eps, 5)
        size = [np.ptp(p[k == c], axis=0).mean() for c in range(k.max() + 1)]
        return np.mean(size) - 30.0 if size else -100.0

    cost = lambda e: fitting.NO_CLUSTER if signed(e) == -100.0 else abs(signed(e))
    want = fitting.bounded_minimum(cost, 2.0, 14.0, 1.0)
    got = fitting.find_eps(df, 30.0, 2.0, 14.0, 5, tolerance=1.0)
    assert np.allclose(got, want)
    samples = df.withColumn("fraction", F.lit(1.0))
    row = fitting.chained_radii(samples, {1.0: 30.0}, 4.0, min_samples=5, step=1.0, accept=0.01).first()
    assert np.allclose((row["eps"], row["cost"], row["steps"]), fitting.halving_search(signed, 4.0, 1.0, 0.01)) and row["steps"] == 20


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_radii_without_pairs(spark, monkeypatch, kind):
    """Above the bound of pairs no forest is built; the clusters are the same, at radii of zero and less too."""
    monkeypatch.setattr(fitting, "PAIRS", 0)
    p = clumps(kind)
    df = frame(spark, p, z=0.0)
    found = fitting.all_radii(df, 9.0, 5)
    assert isinstance(found, fitting.RadiusCells) and not hasattr(found, "near")
    for eps in (-3.0, 0.0, 2.5):
        want = sequential_dbscan(p, eps, 5) if eps >= 0 else np.full(len(p), -1)
        near = [(((p - q) ** 2).sum(axis=1) <= eps * eps).sum() for q in p]
        first = {k: min(i for i in range(len(p)) if want[i] == k and near[i] >= 5) for k in range(want.max() + 1)}
        assert {r["id"]: r["component"] for r in found.clusters(eps).collect()} == {i: first[k] for i, k in enumerate(want.tolist()) if k >= 0}, eps


def test_a_crowd_gets_no_table_of_pairs(spark):
    crowd = spark.range(20_000).select("id", (F.rand(1) * 9).alias("x"), (F.rand(2) * 9).alias("y"), F.lit(0.0).alias("z"))
    found = fitting.all_radii(crowd, 20.0)
    assert isinstance(found, fitting.RadiusCells) and abs(found.signed_cost(5.0, 9.0)) < 0.1
    assert isinstance(fitting.all_radii(crowd.limit(100), 20.0), fitting.RadiusForest)
