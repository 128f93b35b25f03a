"""Quality of texts by learning from positive and unlabelled documents.

The trusted positives are documents labelled good; the unlabelled ones are all documents to learn from, whatever their label. A
linear classifier g over statistics of the whole text minimises the non-negative risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]) + ridge / 2 * |w|^2

with the logistic loss, so the sigmoid of g is a score between 0 and 1. The second term is the risk of the negatives, which no label
names; where it falls below zero, the step goes up its gradient instead. Steps are Newton's, halved until the risk falls.

The class prior is estimated by the best bin: a classifier that tells positives from unlabelled is fitted on one half of the
documents; on the other half, the share of unlabelled over the share of positives among scores above a threshold bounds the prior,
and the threshold with the least upper confidence bound is taken.

All labelled and unlabelled documents count, none is sampled: statistics of the texts are stored once, and every step is one sum over
them, added up by tasks before a bounded number of rows reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import hot_keys, lookup, map_arrow, stored

#: Kinds of bytes: lower case, upper case, digits, white space, ends of sentences, marks inside them, other ASCII, the rest.
LOWER, UPPER, DIGIT, SPACE, END, MARK, OTHER, WIDE, KINDS = *range(8), 8
#: Statistics of a text, the constant included.
FEATURES = KINDS * KINDS + 8 + 1
RIDGE, STEPS, CLOSE = 1e-4, 30, 1e-5
#: Steps in a row that gain nothing, at most, while the negatives' risk goes below zero.
IDLE = 4
#: Bins of the scores in the prior's estimate; the bound's confidence, and the weight of the positives' deviation in it.
BINS, DELTA, GAMMA = 2000, 0.1, 0.01
#: Rows of sums that reach the driver at most.
SUMS = 32


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return WIDE
    if c.islower() or c.isupper():
        return LOWER if c.islower() else UPPER
    if c.isdigit() or c.isspace():
        return DIGIT if c.isdigit() else SPACE
    return END if c in ".?!" else MARK if c in ",;:'\"()-" else OTHER


KIND = np.array([_kind(b) for b in range(256)], dtype=np.uint8)


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text: how kinds of bytes follow each other, lengths, repetition of words and lines, and compression."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = KIND[np.frombuffer(raw, dtype=np.uint8)]
    out = np.zeros(FEATURES, dtype=np.float32)
    out[-1] = 1.0
    if len(kinds) > 1:
        out[: KINDS * KINDS] = np.sqrt(np.bincount(kinds[:-1] * np.uint8(KINDS) + kinds[1:], minlength=KINDS * KINDS) / (len(kinds) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    known, rows, n = len(set(words)), len(set(lines)), len(words)
    small = len(zlib.compress(raw, 1)) if raw else 0
    more = (
        math.log1p(n) / 5, n and math.log(known) / math.log(n + 1), n and math.log1p(sum(map(len, words)) / n), rows and rows / len(lines), rows and math.log1p(n / len(lines)) / 3,
        small and small / (len(raw) + 12), small and math.log(small) / math.log(len(raw) + 12), float(not n),
    )
    out[KINDS * KINDS : -1] = more
    return out


@dataclass
class QualityModel:
    """Mean and scale of the statistics, the weights, the constant last, and the class prior they were fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return sigmoid((vectors - self.mean) / self.scale @ self.weights)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of margins z."""
    return np.logaddexp(0, -z)


def sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What one pass adds up at weights w: counts, risks, gradients and the curvature, in one vector.

    All rows are unlabelled ones; those in `positive` are positives besides.
    """
    z = x @ w
    p = sigmoid(z)
    q, zq = x[positive], z[positive]
    pull = np.column_stack([q.sum(axis=0), p[positive] @ q, p @ x])
    return np.concatenate([[len(x), len(q), _loss(zq).sum(), _loss(-zq).sum(), _loss(-z).sum()], pull.T.reshape(-1), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1), ((q * (p[positive] * (1 - p[positive]))[:, None]).T @ q).reshape(-1)])


@dataclass
class Risk:
    """The objective at some weights, its direction of descent and whether the negatives' risk was below zero."""

    value: float
    step: np.ndarray
    below: bool


def non_negative(total: np.ndarray, w: np.ndarray, prior: float, ridge: float = RIDGE) -> Risk:
    """Non-negative risk of positives and unlabelled from the sums at w."""
    d = len(w)
    n, k, good, swapped, bad = total[:5]
    mean_q, pull_q, pull_x = (total[5 + i * d : 5 + (i + 1) * d] / m for i, m in enumerate((k, k, n)))
    curve = total[5 + 3 * d : 5 + 3 * d + d * d].reshape(d, d) / n
    free = np.append(np.full(d - 1, ridge), ridge * 1e-3)
    kept = 0.5 * float(free @ (w * w))
    hessian = curve + np.diag(free)
    negatives = bad / n - prior * swapped / k
    value = prior * good / k + max(0.0, negatives) + kept
    if negatives < 0:
        return Risk(value, np.linalg.solve(hessian, pull_x - prior * pull_q), True)
    return Risk(value, -np.linalg.solve(hessian, pull_x - prior * mean_q + free * w), False)


def separating(total: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> Risk:
    """Risk of telling positives from unlabelled, each side with the same weight."""
    d = len(w)
    n, k, good, _, bad = total[:5]
    mean_q, pull_q, pull_x = (total[5 + i * d : 5 + (i + 1) * d] / m for i, m in enumerate((k, k, n)))
    both = total[5 + 3 * d :].reshape(2, d, d)
    free = np.append(np.full(d - 1, ridge), ridge * 1e-3)
    hessian = both[0] / n + both[1] / k + np.diag(free)
    return Risk(good / k + bad / n + 0.5 * float(free @ (w * w)), -np.linalg.solve(hessian, pull_x + pull_q - mean_q + free * w), False)


def minimise(at, w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the least risk found by `at`(w) -> Risk: Newton steps, halved until the risk falls; it ends when it hardly does."""
    now, best = at(w), w
    least, size, idle = now.value, 1.0, 0
    for _ in range(steps):
        tried = w + size * now.step
        risk = at(tried)
        idle = 0 if least - risk.value > CLOSE * max(1.0, abs(least)) else idle + 1
        if risk.value < least:
            best, least = tried, risk.value
        if risk.value <= now.value or now.below:
            if idle >= (IDLE if now.below or risk.below else 1):
                break
            w, now, size = tried, risk, 1.0
        else:
            size /= 2
            if size < 1e-3:
                break
    return best


def best_bin(unlabelled: np.ndarray, positive: np.ndarray, delta: float = DELTA, gamma: float = GAMMA) -> float:
    """Class prior from counts of unlabelled and positives in bins of a score, lowest first."""
    above_u, above_p = unlabelled[::-1].cumsum() / unlabelled.sum(), positive[::-1].cumsum() / positive.sum()
    use = above_p > 0
    slack = math.sqrt(math.log(4 / delta) / 2 / unlabelled.sum()) + (1 + gamma) * math.sqrt(math.log(4 / delta) / 2 / positive.sum())
    place = int(np.argmin((above_u[use] + slack) / above_p[use]))
    return float(min(1.0, max(above_u[use][place] / above_p[use][place], 1e-3)))


def _vectors(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Stored statistics of each document and whether a trusted label calls it good: vector, positive, half.

    Only labels without contradiction are trusted. Equal texts lie in one half.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "vector"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(label) > 0).alias("positive")).where("positive")
    measured = map_arrow(own, measure, "doc_id long, vector binary")
    marked = lookup(measured, "doc_id", good, hot_keys(own, "doc_id"), ["vector"])
    return stored(marked.select("vector", F.coalesce("positive", F.lit(False)).alias("positive"), F.pmod(F.xxhash64("vector"), F.lit(2)).cast("int").alias("half")), "quality-vectors")


def added(rows: DataFrame, function) -> np.ndarray:
    """The sum of function(vectors, positive) over blocks of rows; tasks add up theirs first, at most SUMS rows reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1).astype(np.float64)
                part = function(x, np.array(batch.column(1).to_pylist(), dtype=bool))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(total.tobytes()) % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def joined(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("total").to_pylist())
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = map_arrow(rows.select("vector", "positive"), partial, "part int, total binary")
    found = sorted(bytes(r["total"]) for r in parts.groupBy("part").applyInArrow(joined, "total binary").collect())
    return sum((np.frombuffer(x, dtype=np.float64) for x in found), start=np.zeros(1))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", prior: float | None = None) -> QualityModel | float:
    """Fits on all rows of docs (doc_id, text) as unlabelled and those that labels (doc_id, label) call good as positives.

    Without any positive nothing is known of quality: the result is then the constant score 0.5. prior: the share of good documents,
    estimated if None. Rows labelled bad are unlabelled ones.
    """
    rows = _vectors(docs, labels, label)
    moments = added(rows, lambda x, positive: np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if len(moments) < 2 or not moments[1]:
        return 0.5
    mean, square = moments[2:].reshape(2, -1) / moments[0]
    mean[-1], scale = 0.0, np.sqrt(np.maximum(square - mean * mean, 1e-6))
    scale[-1] = 1.0

    def at(part: DataFrame, judge):
        return lambda w: judge(added(part, lambda x, positive: sums((x - mean) / scale, positive, w)), w)

    zero = np.zeros(len(mean))
    if prior is None:
        one, other = rows.where("half = 0"), rows.where("half = 1")
        counted = one.agg(F.count_if("positive").alias("k")).first()["k"], other.agg(F.count_if("positive").alias("k")).first()["k"]
        one, other = (one, other) if all(counted) else (rows, rows)
        w = minimise(at(one, separating), zero)

        def binned(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            place = np.minimum((sigmoid((x - mean) / scale @ w) * BINS).astype(int), BINS - 1)
            return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[positive], minlength=BINS)]).astype(np.float64)

        prior = best_bin(*added(other, binned).reshape(2, BINS))
    return QualityModel(mean, scale, minimise(at(rows, lambda total, w: non_negative(total, w, prior)), zero), prior)


def score_quality(docs: DataFrame, model: QualityModel | float, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, score, predicted (1 if score >= threshold).

    Null text counts as empty text, which has a score too. Repeated rows score alike; other columns are left out.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if isinstance(model, float):
                s = np.full(len(texts), model)
            else:
                s = model.scores(np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), score, "doc_id long, score double, predicted int")
