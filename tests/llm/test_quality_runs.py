"""Positive-unlabelled quality and periodic runs, against brute force and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from nubila.llm import quality, queries, runs


def brute_runs(w):
    """Stretches of equal words q apart, for every q; of one stretch the smallest q is its period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def drawn_words(rng, most):
    kinds, n, w = rng.choice([1, 2, 2, 3, 5, 30]), rng.randrange(most), []
    while len(w) < n:
        block = [str(rng.randrange(kinds)) for _ in range(rng.randrange(1, 7))]
        w += block if rng.random() < 0.3 else block * rng.randrange(1, 8) + block[: rng.randrange(len(block))]
    return w[:n]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        w = drawn_words(rng, 70)
        assert runs.find_runs(w) == brute_runs(w)
    for _ in range(10):
        w = drawn_words(rng, 900)
        assert runs.find_runs(w) == brute_runs(w)


def test_runs_of_words_whose_words_repeat_everywhere():
    short, long = ["a"], ["a", "b"]
    while len(long) < 2000:
        short, long = long, long + short
    assert runs.find_runs(long) == brute_runs(long) == []  # no exponent of four in it
    for w in (["x"] * 5000, ("a b c d e f g " * 700).split() + ["a"], ["z"] + ["x", "y"] * 4 + ["x", "x"]):
        assert runs.find_runs(w) == [r for r in brute_runs(w[:400] if len(w) > 400 else w)] or len(w) > 400
    assert runs.find_runs(["x"] * 5000) == [(0, 5000, 1)] and runs.find_runs(("a b c d e f g " * 700).split() + ["a"]) == [(0, 4901, 7)]


def test_lyndon_words_and_common_stretches():
    rng = random.Random(4)
    for _ in range(300):
        c = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        common = runs.Common(c)
        assert runs.next_smaller(c, common) == [next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c)) for i in range(len(c))]
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                assert common.prefix(i, j) == next((k for k in range(len(c) - j) if c[i + k] != c[j + k]), len(c) - j)
                assert common.suffix(i, j) == next((k for k in range(i) if c[i - 1 - k] != c[j - 1 - k]), i)


def test_hash_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(runs.Common, "powers", [1])
    monkeypatch.setattr(runs, "PRIME", 11)
    monkeypatch.setattr(runs, "BASE", 3)
    rng = random.Random(5)
    for _ in range(400):
        w = drawn_words(rng, 60)
        assert set(runs.find_runs(w)) <= set(brute_runs(w))


def test_windows_of_many_different_words(monkeypatch):
    monkeypatch.setattr(runs, "NARROW", 1)
    w = [str(i) for i in range(3000)] + ["p", "q", "r"] * 5
    wide = np.arange(1 << 21) % ((1 << 21) - 3)
    assert runs.find_runs(w) == [(3000, 15, 3)] and runs.windows(wide) == []


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "b c " * 5), (7, "a a " * 5), (8, "x y z")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, runs int, `a.b` string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect()), key=repr)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (None, [(0, 10, 2)], "b c"), (7, [], " ".join(["a a"] * 5)), (8, [], "x y z")]
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_sums_equal_their_definition():
    rng = np.random.default_rng(2)
    x, w, positive, prior = np.column_stack([rng.normal(size=(300, 4)), np.ones(300)]), rng.normal(size=5), rng.random(300) < 0.4, 0.7
    loss = lambda z: np.log(1 + np.exp(-z))

    def whole(v):
        z = x @ v
        kept = 0.5 * ((1e-4 * v[:-1] ** 2).sum() + 1e-7 * v[-1] ** 2)
        return prior * loss(z[positive]).mean() + max(0, loss(-z).mean() - prior * loss(-z[positive]).mean()) + kept

    risk = quality.non_negative(quality.sums(x, positive, w) , w, prior)
    assert abs(risk.value - whole(w)) < 1e-9
    # Along the step the objective, or the negatives' risk where it is below zero, changes as promised.
    change = (whole(w + 1e-5 * risk.step) - risk.value) / 1e-5
    assert risk.below or change < 0
    parts = sum(quality.sums(x[i : i + 50], positive[i : i + 50], w) for i in range(0, 300, 50))
    assert np.allclose(parts, quality.sums(x, positive, w))


def test_risk_below_zero_is_climbed():
    """Few unlabelled far on the positives' side: the unbiased risk of the negatives is negative there, and the step raises it."""
    rng = np.random.default_rng(3)
    x, positive, w, prior = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)]), np.arange(200) < 100, np.array([0.0, 0.0, 0.0, 6.0]), 0.999
    x[:100, 0] += 3
    w[0] = 2.0
    below = lambda v: (np.log1p(np.exp(x @ v)).mean() - prior * np.log1p(np.exp((x @ v)[positive])).mean())
    risk = quality.non_negative(quality.sums(x, positive, w), w, prior)
    assert risk.below == (below(w) < 0)
    if risk.below:
        assert below(w + 1e-4 * risk.step) > below(w)


def test_minimum_is_no_worse_than_descent():
    """The steps' result against many small steps of plain descent on the same risk."""
    rng = np.random.default_rng(5)
    x, prior = np.column_stack([rng.normal(size=(600, 2)), np.ones(600)]), 0.6
    good = rng.random(600) < prior
    x[good, 0] += 2.5
    positive = good & (rng.random(600) < 0.5)
    at = lambda v: quality.non_negative(quality.sums(x, positive, v), v, prior)
    w = quality.minimise(at, np.zeros(3))
    v = np.zeros(3)
    for _ in range(4000):
        slope = np.array([(at(v + d).value - at(v - d).value) / 2e-5 for d in 1e-5 * np.eye(3)])
        v -= 0.05 * slope
        if np.abs(slope).max() < 1e-4:
            break
    assert at(w).value <= at(v).value + 1e-3


def test_best_bin_equals_every_threshold():
    rng = np.random.default_rng(6)
    good, bad = rng.beta(5, 2, 4000), rng.beta(2, 8, 1000)
    unlabelled, positive = np.concatenate([good, bad]), rng.beta(5, 2, 3000)
    count = lambda v: np.bincount(np.minimum((v * 200).astype(int), 199), minlength=200).astype(float)
    slack = np.sqrt(np.log(40) / 2 / 5000) + 1.01 * np.sqrt(np.log(40) / 2 / 3000)
    tried = [((unlabelled >= c).mean(), (positive >= c).mean()) for c in np.arange(200) / 200]
    u, p = min((t for t in tried if t[1]), key=lambda t: (t[0] + slack) / t[1])
    assert abs(quality.best_bin(count(unlabelled), count(positive)) - u / p) < 1e-6 and abs(u / p - 0.8) < 0.08


def ranked_right(rows):
    """Share of (good, bad) pairs in the right order."""
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_of_held_out_documents(spark, small):
    got = queries.op11_quality(spark, small).collect()
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], known[r["doc_id"]]) for r in got if r["held_out"] and known.get(r["doc_id"]) is not None]
    assert ranked_right(held) > 0.97 and np.mean([s >= 0.3 for s, y in held if y]) > 0.97


def test_one_whole_fit_equals_numpy(spark, tiny):
    """The fit over Spark's partitions against the same steps over one array."""
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality.fit_quality(docs.repartition(7), labels, prior=0.8)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    rows = docs.collect()
    x = np.array([quality.features(r["text"]) for r in rows], dtype=float)
    positive = np.array([r["doc_id"] in good for r in rows])
    z = (x - model.mean) / model.scale
    w = quality.minimise(lambda v: quality.non_negative(quality.sums(z, positive, v), v, 0.8), np.zeros(x.shape[1]))
    assert np.allclose(model.scores(x), quality.sigmoid(z @ w), atol=1e-3) and np.allclose(model.mean[:-1], x.mean(axis=0)[:-1], atol=1e-6)


@pytest.mark.parametrize("kind", ["none", "odd"])
def test_quality_of_odd_rows(spark, kind):
    rows = [(1, None, 1), (2, "", 1), (3, "Plain words in a row.", 2), (3, "Plain words in a row.", 2), (None, "x " * 3000, 3), (5, "!!!" * 200, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([] if kind == "none" else [(3, 1, 0), (3, 1, 1), (1, None, 0), (None, 1, 1), (5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == got[3]["score"]
    assert (model == 0.5) == (kind == "none")
    assert quality.score_quality(docs.limit(0), model).count() == 0 and quality.fit_quality(docs.limit(0), labels) == 0.5


