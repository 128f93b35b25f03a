"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries are trained by the library (COVER) on windows of a bounded sample of labelled rows: one on ordinary text, one
on toxic text. Every window of a text is compressed with the ordinary dictionary and with the toxic one laid on the same ordinary
ground; the bytes that toxic content saves are the window's distance. Laid on its own, a toxic dictionary also differs by what
ordinary text it happens to hold, which hides the few toxic words of a window.

Most windows of a toxic text are ordinary, so the toxic dictionary is trained again, `ROUNDS` times, on the windows that save
most: two halves of the sample pick each other's windows, so none is picked by a dictionary that has seen it. Each time the
ordinary ground gets a second dictionary, trained on those ordinary windows that the toxic one still saves on. A logistic
calibration on texts that trained neither dictionary turns a text's distances into a score; its threshold is 0.5. Scores are
calibrated on the sample's mix, up to one toxic text for two ordinary ones, so a missed toxic text weighs more than a false alarm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import cached, filter_arrow, map_arrow, stored

#: Labelled rows in the fit, at most: toxic and ordinary; and windows of one of their texts that train, at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_WINDOWS = 1500, 3000, 64
#: Bytes of a window and from one to the next. Literals of so few bytes are stored as they are, so lengths count matches only.
WINDOW, STEP = 64, 48
#: Bytes of the dictionaries; COVER's segment and pattern length.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES, SEGMENT, PATTERN = 112_640, 16_384, 8_192, 16, 8
ROUNDS, PICKED = 3, 4
FEATURES = 8
#: With fewer toxic texts than this the calibration goes through all folds instead of one of FOLDS.
FEW, FOLDS = 150, 6
APART = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, with one space between words and at both ends."""
    return " " + APART.sub(" ", (text or "").lower()).strip() + " "


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows that cover the whole text."""
    raw = plain(text).encode("utf-8", "replace")
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; of samples too few to train on, the samples themselves, the last `size` bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PATTERN).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[-size:]


def compressor(content: bytes):
    """A compressor that finds the longest match in the content and stores the rest of a window as it is."""
    import zstandard

    options = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, target_length=32, min_match=4, hash_log=17, chain_log=18, search_log=5, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content or b"\x00" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=options)


def saved(parts: list[bytes], ordinary, toxic) -> np.ndarray:
    """Bytes that the toxic compressor saves in each window."""
    one, two = ordinary.compress, toxic.compress
    return np.array([len(one(w)) - len(two(w)) for w in parts], dtype=np.float64)


@dataclass
class ToxicityModel:
    """Two dictionaries and the calibration: mean and scale of the features, and their weights, the constant last."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        return cached(("toxicity", hash(self.toxic), hash(self.ordinary)), lambda: (compressor(self.ordinary), compressor(self.toxic + self.ordinary)))

    def features(self, text: str | None) -> np.ndarray:
        d = saved(windows(text), *self.compressors())
        top = np.sort(d)[::-1][:3]
        return np.array([d.mean(), d.max(), top.mean(), np.quantile(d, 0.9), (d >= 2).mean(), (d >= 4).mean(), (d >= 3).sum() / math.sqrt(len(d)), math.log(len(d))])

    def score(self, text: str | None) -> float:
        z = float(((self.features(text) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The toxic dictionary and the ordinary ground, from the windows of each toxic and ordinary text."""
    base = trained(ORDINARY_BYTES, [w for t in ordinary[::2] for w in t])
    halves = toxic[::2], toxic[1::2]
    picked = [[w for t in half for w in t] for half in halves]
    own, ground, plain_only = [trained(TOXIC_BYTES, p) for p in picked], base, compressor(base)
    for _ in range(rounds):
        one = compressor(ground)
        for i, half in enumerate(halves):
            two, chosen = compressor(own[1 - i] + ground), []
            for t in half:
                gain = saved(t, one, two)
                best = np.argsort(-gain, kind="stable")[: max(2, len(t) // PICKED)]
                chosen += [t[k] for k in best if gain[k] > 0]
            picked[i] = chosen or picked[i]
        own = [trained(TOXIC_BYTES, p) for p in picked]
        both = compressor(own[0] + own[1] + base)
        # Texts that the ground was not trained on, as a text to be scored isn't.
        hard = [w for t in ordinary[1::2] for w, gain in zip(t, saved(t, plain_only, both), strict=True) if gain > 0]
        ground = (trained(HARD_BYTES, hard) if hard else b"") + base
    return trained(TOXIC_BYTES, picked[0] + picked[1]), ground


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 60) -> np.ndarray:
    """Newton steps of penalised logistic regression; the constant is last and free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, free = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(free), z.T @ (y - p) - free * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_ordinary: int) -> DataFrame:
    """The labelled texts that are drawn: doc_id, text, toxic.

    An id with both labels counts as toxic. The draw goes by hash of doc_id.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") > 0).alias("toxic"))
    drawn = None
    for kind, most in ((True, most_toxic), (False, most_ordinary)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most most_toxic + most_ordinary ids: small whatever the input.
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    return stored(texts, "toxicity-sample")


def _cut(sample: DataFrame) -> list[tuple[bool, bytes, list[bytes]]]:
    """Label, key and training windows of each distinct sampled text; nothing longer reaches the driver.

    The key is the smallest hash of the text's five-word runs, which near copies mostly share: of texts with one key and label one
    stays, and a key lies in one fold. Of a text with more windows than SAMPLE_WINDOWS as many are drawn, by their hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, parts = [], []
            for text in batch.column(0).to_pylist():
                words = plain(text).split()
                keys.append(min((xxhash.xxh3_64_digest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=b""))
                own = windows(text)
                drawn = sorted(range(len(own)), key=lambda i: xxhash.xxh3_64_digest(own[i], 7))[:SAMPLE_WINDOWS]  # noqa: B023
                parts.append([own[i] for i in sorted(drawn)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.binary())), batch.column(1)], names=["key", "parts", "toxic"])

    found = {}
    for r in map_arrow(sample.select("text", "toxic"), cut, "key binary, parts array<binary>, toxic boolean").toLocalIterator():
        entry = (r["toxic"], bytes(r["key"])), [bytes(w) for w in r["parts"]]
        if entry[0] not in found or entry[1] < found[entry[0]]:
            found[entry[0]] = entry[1]
    return [(toxic, key, parts) for (toxic, key), parts in sorted(found.items())]


def _fold(key: bytes, folds: int) -> int:
    return int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 % 2**64 * folds >> 64


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_ordinary: int = SAMPLE_ORDINARY) -> ToxicityModel | float:
    """Fits on at most `most_toxic` and `most_ordinary` rows of labels (doc_id, toxic), drawn by hash of doc_id.

    Without both labels, or without texts for both, there is nothing to tell apart: the result is then a constant score, 1.0 if
    only toxic texts exist, else 0.0. Only bounded windows and feature vectors of the sample reach the driver.
    """
    sample = _sample(docs, labels, most_toxic, most_ordinary)
    rows = _cut(sample)
    positives = sum(t for t, _, _ in rows)
    if not positives or positives == len(rows):
        return 1.0 if positives else 0.0
    folds = FOLDS if positives >= FEW else max(2, min(8, positives, len(rows) - positives))
    zeros = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)

    def train(keep) -> ToxicityModel:
        parts = [[p for t, key, p in rows if t == kind and keep(key)] for kind in (True, False)]
        return ToxicityModel(*train_dictionaries(*parts), *zeros)

    models = {f: train(lambda key: _fold(key, folds) != f) for f in (range(1) if positives >= FEW else range(folds))}  # noqa: B023
    keys = {(t, key) for t, key, _ in rows}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain(text).split()
                key = min((xxhash.xxh3_64_digest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=b"")
                fold = _fold(key, folds)
                if (toxic, key) in keys and fold in models:
                    out.append((toxic, key, models[fold].features(text).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.bool_(), pa.binary(), pa.list_(pa.float64())))], names=["toxic", "key", "x"])

    # One text of each key calibrates, like one trained.
    measured = {(r["toxic"], bytes(r["key"])): r["x"] for r in sorted(map_arrow(sample.select("text", "toxic"), measure, "toxic boolean, key binary, x array<double>").collect(), key=lambda r: r["x"])}
    model = models[0] if positives >= FEW else train(lambda key: True)
    x, y = np.array(list(measured.values())), np.array([float(t) for t, _ in measured])
    if not 0 < y.sum() < len(y):
        return positives / len(rows)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def _scores(model: ToxicityModel | float, texts: list) -> list[float]:
    return [model if isinstance(model, float) else model.score(t) for t in texts]


def score_toxicity(docs: DataFrame, model: ToxicityModel | float, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, score, predicted (1 if score >= threshold).

    Null text counts as empty text, which has a score too. Repeated rows score alike; other columns are left out.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), score, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel | float, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; ties at it go. Null text counts as empty."""
    return filter_arrow(docs, "text", lambda texts: [s < threshold for s in _scores(model, texts)])
