"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1. For each bit one linear classifier (ridge regression on hashed byte trigram and
tetragram frequencies) is fitted on a bounded sample of labelled rows of every language. Decoding sums, over bits, the bit's weight times the
exponential loss of its margin against each codeword; the codeword with the least loss wins, and a small lead over the second
flags the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.llm.common import map_arrow, stored

DIMENSIONS = 2048
#: Labelled rows of each language in the fit, at most.
SAMPLE_PER_LANGUAGE = 600
NON_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
SPACES = re.compile(rb" +")


def features(text: str) -> np.ndarray:
    """Unit vector of root counts of hashed byte 3- and 4-grams of the lower-cased text, other ASCII than letters as space."""
    raw = SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(NON_LETTERS) + b" ")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    if len(b) >= 3:
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        out += np.bincount((three >> np.uint32(12)) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
        if len(b) >= 4:
            four = three[:-1] * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
            out += np.bincount((four >> np.uint32(13)) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
    np.sqrt(out, out=out)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(classes: int) -> np.ndarray:
    """A row of +-1 for each class: the exhaustive code up to 7 classes, else the best of seeded random codes."""
    if classes <= 2:
        return np.array([[1.0], [-1.0]])[:classes]
    if classes <= 7:
        bits = np.arange(1, 2 ** (classes - 1))
        rows = [np.ones(len(bits))] + [1.0 - 2.0 * (bits >> (classes - 2 - k) & 1) for k in range(classes - 1)]
        return np.array(rows)
    rng, best, far = np.random.default_rng(7), None, -1
    width = int(10 * np.ceil(np.log2(classes)))
    for _ in range(max(1, min(100, 10**9 // (classes * classes * width)))):
        code = rng.choice([-1.0, 1.0], size=(classes, width))
        apart = int(((width - code @ code.T) / 2 + width * np.eye(classes)).min())
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    mean: np.ndarray

    def decode(self, vectors: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score in 0..1, and its lead over the second."""
        margins = np.clip((vectors - self.mean) @ self.weights, -3, 3)
        # The loss of a bit is exp(-margin) where the codeword has +1, else exp(margin).
        loss = (np.exp(-margins) * self.bit_weights) @ (self.code > 0).T + (np.exp(margins) * self.bit_weights) @ (self.code < 0).T
        share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        return best.tolist(), share[np.arange(len(best)), best], lead


def sampled_vectors(labelled: DataFrame, per_language: int) -> DataFrame:
    """(lang, vector) of at most `per_language` rows with a letter of each language, the least hashes of the text first.

    Rows are thinned by their language's count before they meet, so a frequent language doesn't meet in one task.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # One row for each language.
    counts = rows.groupBy("lang").agg(F.count("*").alias("__n")).withColumn("__share", F.lit(1.3 * per_language) / F.col("__n") + F.lit(8.0) / F.col("__n"))
    key = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    drawn = rows.withColumn("__key", key).join(F.broadcast(counts), "lang").where(F.col("__key") < F.col("__share"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, key, features(text).tobytes()) for text, lang, key in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.string(), pa.float64(), pa.binary()))], names=["lang", "key", "vector"])

    found = map_arrow(drawn.select("text", "lang", "__key"), vectors, "lang string, key double, vector binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "vector")))
    return ranked.where(F.col("rank") <= per_language).select("lang", "vector")


def fit_language_model(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, ridge: float = 0.3) -> LanguageModel | None:
    """Fits on at most `per_language` rows (text, lang) of each language, drawn by hash of the text; None without labels.

    The regression is solved in the vectors' dimensions from sums over the stored sample, read block by block, so the driver's
    memory doesn't grow with the number of languages but for their names and codewords.
    """
    sample = stored(sampled_vectors(labelled, per_language), "langid-sample")
    size = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not size:
        return None
    languages = sorted(size)
    place, code = {k: i for i, k in enumerate(languages)}, codewords(len(languages))
    # Each language weighs the same in the fit.
    weigh = np.array([sum(size.values()) / len(size) / size[k] for k in languages])

    def blocks(rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = [], []
        for r in sample.toLocalIterator():
            x.append(np.frombuffer(r["vector"], dtype=np.float32))
            y.append(place[r["lang"]])
            if len(x) == rows:
                yield np.array(x, np.float64), np.array(y)
                x, y = [], []
        if x:
            yield np.array(x, np.float64), np.array(y)

    count, total, first, gram, cross = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, DIMENSIONS)), np.zeros((DIMENSIONS, code.shape[1]))
    weight, target = 0.0, np.zeros(code.shape[1])
    for x, y in blocks():
        w = weigh[y][:, None]
        count, total = count + len(x), total + x.sum(axis=0)
        weight, first, target = weight + float(w.sum()), first + (w * x).sum(axis=0), target + (w * code[y]).sum(axis=0)
        gram += (w * x).T @ x
        cross += (w * x).T @ code[y]
    mean = total / count
    # The same sums for vectors around their mean.
    gram += weight * np.outer(mean, mean) - np.outer(first, mean) - np.outer(mean, first)
    cross -= np.outer(mean, target)
    inverse = np.linalg.inv(gram + ridge * np.eye(DIMENSIONS))
    solved = inverse @ cross
    # Margins of the rows left out one by one give the weights of the bits.
    right = np.zeros(code.shape[1])
    for x, y in blocks():
        centred = x - mean
        lever = weigh[y] * ((centred @ inverse) * centred).sum(axis=1)
        left_out = code[y] - (code[y] - centred @ solved) / np.maximum(1 - lever, 1e-9)[:, None]
        right += ((left_out * code[y]) > 0).sum(axis=0)
    bit_weights = np.clip(right / count, 0.51, 0.9999)
    bit_weights = np.log(bit_weights / (1 - bit_weights))
    return LanguageModel(languages, code, solved.astype(np.float32), bit_weights / bit_weights.sum(), mean.astype(np.float32))


def identify_languages(docs: DataFrame, model: LanguageModel | None, ambiguous_lead: float = 0.2) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, ambiguous.

    Null texts, texts without a letter, and all texts where there is no model are `und` with score 0 and ambiguous. Repeated
    rows are scored alike; other columns are left out.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                named, scores, unsure = ["und"] * len(part), [0.0] * len(part), [True] * len(part)
                known = [i for i, t in enumerate(part) if model is not None and t is not None and has_letter(t)]
                if known:
                    best, score, lead = model.decode(np.array([features(part[i]) for i in known]))
                    for i, k, s, d in zip(known, best, score.tolist(), lead.tolist(), strict=True):
                        named[i], scores[i], unsure[i] = model.languages[k], float(s), d < ambiguous_lead
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), predict, "doc_id long, lang_pred string, score double, ambiguous boolean")
