"""Exact quantiles against numpy."""

import numpy as np
import pytest

from nubila.functions import quantiles
from nubila.operators import filters


@pytest.mark.parametrize("bins, broadcast, direct", [(4096, 50_000, 0), (256, 0, 0), (4096, 50_000, 100_000)])
def test_quantiles_equal_numpy(spark, monkeypatch, bins, broadcast, direct):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "BROADCAST", broadcast)
    monkeypatch.setattr(quantiles, "DIRECT", direct)
    rng = np.random.default_rng(1)
    groups = {
        1: rng.normal(size=900), 2: np.exp(30 * rng.normal(size=500)), 3: rng.integers(0, 4, 400).astype(float), 4: np.array([7.0]), 5: np.array([-1e308, 1e308, 1.7e308, -1.7e308]),
        6: np.full(300, -2.5), 7: np.array([0.0, 5e-324, 1e-323]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (1, float("nan")), (8, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    shares = (0.0, 0.05, 0.5, 0.99, 1.0)
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, "v", shares, ["k"]).collect()}
    for k, vs in groups.items():
        with np.errstate(over="ignore"):
            v = np.sort(vs)
            at = np.array(shares) * (len(v) - 1)
            low, part = np.floor(at).astype(int), at % 1
            want = v[low] * (1 - part) + v[np.minimum(low + 1, len(v) - 1)] * part
        assert np.allclose(got[k], want, rtol=1e-12, atol=0), k
    assert 8 not in got
    one = quantiles.exact_quantiles(df.where("k = 1"), "v", shares).collect()
    assert len(one) == 1 and np.allclose(one[0]["q"], np.quantile(groups[1], shares))
    assert [r["q"] for r in quantiles.exact_quantiles(df.limit(0), "v", shares).collect()] == [None]


def test_trim_by_keys_and_without_values(spark):
    df = spark.createDataFrame([(k, float(i)) for k in (1, 2) for i in range(101)] + [(3, None)], "k int, v double")
    assert filters.filter_quantile(df, "v", 0.05, ["k"]).count() == 2 * 91
    assert filters.filter_quantile(df.where("k = 3"), "v").count() == 0 and filters.filter_quantile(df.limit(0), "v").count() == 0
    assert {r["k"]: r["upper"] for r in filters.plot_limit(df, "v", 0.99, ["k"]).collect()} == {1: 99.0, 2: 99.0}
