"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. Every hash function is evaluated once for a set and gives two signature
values, the smallest and the largest, so a signature takes half the evaluations of min-hashing. Signatures are cut into bands;
documents that agree in a band are candidates, and every link is confirmed on the full sets.

How groups are kept small:
* equal sets are one class, found by a partial aggregation over a 128-bit digest of the set; a class has a number of its own, so
  rows that repeat a doc_id with other texts are told apart;
* in each band's bucket every class is compared with one leader only (the smallest number, then the largest); confirmed links give
  components;
* classes of buckets that still hold several components are compared once more inside their buckets, those of different
  components only. This work grows with the square of a bucket's classes that aren't linked; large buckets are cut into blocks,
  and each pair of blocks is a join key of its own;
* a pair becomes a row only if sizes and parity sketches leave a link possible. A parity sketch has one bit for each of 1024
  hash places, set if an odd number of the set's shingles fall there; two sketches differ in at most as many bits as the sets
  differ in shingles, so the test loses no link, and it rejects nearly all pairs below the similarity;
* joins on bands, leaders, labels and digests deal the rows of hot keys over all tasks (`lookup`, `spread_join`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import HOT_LEAST, HOT_SHARE, hot_keys, lookup, map_arrow, spread_join, stored

#: 80 hash functions, 160 values in 32 bands of 5: a pair at 0.8 is missed by every band once in about 300,000 pairs.
FUNCTIONS, ROWS = 80, 5
WORD_CACHE = 250_000
#: Longs of a parity sketch.
LONGS = 16


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; A-Z are lower-cased, words are runs without ASCII white space."""

    def __init__(self, size: int):
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, word):
                value = self[word] = digest(word)
                return value

        self.size, self.words, self.factors = size, Words(), _constants(size + 1, 3)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        n = len(h) - size + 1
        out = np.full(n, self.factors[-1], np.uint64) * np.uint64(size)
        for k in range(size):
            out += h[k : k + n] * self.factors[k]
        return np.unique(_mixed(out))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc_id, n_shingles, text_hash, and for a set that isn't empty its digest, band hashes and sketch.

    The sketch is the parity sketch of the set.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, factors, bands = Shingler(shingle), _constants(FUNCTIONS, 17), 2 * FUNCTIONS // ROWS
        mix, salt, places = _constants(ROWS, 29), _constants(bands, 31), np.arange(64, dtype=np.uint64)
        for batch in batches:
            sizes, digests, hashed, packed = [], [], [], []
            for text in batch.column(1):
                own = shingler(text.as_py())
                sizes.append(len(own))
                if not len(own):
                    digests.append(None)
                    hashed.append(None)
                    packed.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                low, high = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(FUNCTIONS, np.uint64)
                for at in range(0, len(own), 4096):
                    values = own[at : at + 4096, None] * factors[None, :]
                    np.minimum(low, values.min(axis=0), out=low)
                    np.maximum(high, values.max(axis=0), out=high)
                sliced = np.concatenate([low, high]).reshape(bands, ROWS)
                odd = np.bincount((own % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS).astype(np.uint64) & np.uint64(1)
                packed.append((odd.reshape(LONGS, 64) << places).sum(axis=1, dtype=np.uint64).view(np.int64))
                hashed.append(_mixed(_mixed(sliced) @ mix + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(digests, pa.binary()), pa.array(hashed, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "text_hash", "digest", "bands", "sketch"])

    text = F.col("text").cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), sign, "doc_id long, n_shingles long, text_hash long, digest binary, bands array<long>, sketch array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """digest and set (distinct shingle hashes) of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                own = [shingler(t.as_py()) for t in batch.column(0).slice(at, 200)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["digest", "set"])

    return map_arrow(texts.select("text"), sets, "digest binary, set array<long>")


def reaches(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with so many common elements reach the similarity."""
    return 100 * common >= percent * (a + b - common)


def may_link(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and parity sketches leave a link possible; true for every link.

    100 c >= p (na + nb - c) bounds the shingles in one set only, na + nb - 2 c, by (na + nb) (100 - p) / (100 + p).
    """
    differing = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for k in range(1, LONGS):
        differing = differing + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * differing <= (100 - percent) * (na + nb))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. The set of a frequent a is sent once for each block of its pairs."""
    right = pairs.join(sets.select(F.col("c").alias("b"), F.col("set").alias("set_b")), "b")
    both = spread_join(right, "a", sets.select(F.col("c").alias("a"), F.col("set").alias("set_a")), hot_keys(pairs, "a"), ["b"])
    sizes = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    return sizes.where(reaches(F.col("common"), F.size("set_a").cast("long"), F.size("set_b").cast("long"), percent)).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(c, component) for all numbers of edges (a, b): the smallest number reachable.

    Each round takes the smallest label of the neighbours and then the label's own label; labels and edges are stored, and only
    counts and the few hot keys reach the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    hubs = hot_keys(both, "b")
    labels = stored(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("low")).select("c", F.least("c", "low").alias("component")), f"{name}-labels")
    while True:
        near = lookup(both, "b", labels.select(F.col("c").alias("b"), F.col("component").alias("label")), hubs, ["a"]).groupBy(F.col("a").alias("c")).agg(F.min("label").alias("label"))
        lower = stored(labels.join(near, "c").select("c", F.col("component").alias("was"), F.least("component", "label").alias("mid")), f"{name}-lower")
        jumped = lookup(lower, "mid", labels.select(F.col("c").alias("mid"), F.col("component").alias("far")), hot_keys(lower, "mid"), ["c"])
        labels = stored(jumped.select("c", "was", F.least("mid", F.coalesce("far", "mid")).alias("component")), f"{name}-labels")
        if labels.where(F.col("was") != F.col("component")).isEmpty():
            return labels.select("c", "component")
        labels = labels.select("c", "component")


def _within_buckets(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one band's bucket and of different components that may be linked; left: band, c, component, n, sketch.

    Rows of a hot band are dealt into blocks of HOT_LEAST, at most HOT_SHARE of them; a row meets each block in a task of its own.
    """
    hot = hot_keys(left, "band")
    rows = left.withColumn("blocks", F.lit(1))
    if hot:
        sizes = left.sparkSession.createDataFrame([(k, min(HOT_SHARE, -(-n // HOT_LEAST))) for k, n in hot.items()], "band long, many int")
        rows = left.join(F.broadcast(sizes), "band", "left").withColumn("blocks", F.coalesce("many", F.lit(1))).drop("many")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    one = rows.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    two = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "block")))
    one = one.select("band", F.col("block").alias("low"), F.col("other").alias("high"), *[F.col(x).alias(f"{x}_a") for x in ("c", "component", "n", "sketch")])
    two = two.select("band", F.col("other").alias("low"), F.col("block").alias("high"), *[F.col(x).alias(f"{x}_b") for x in ("c", "component", "n", "sketch")])
    once = (F.col("low") < F.col("high")) | (F.col("c_a") < F.col("c_b"))
    near = one.join(two, ["band", "low", "high"]).where(once & (F.col("component_a") != F.col("component_b")) & may_link(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), percent))
    return near.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()


def _marked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, text_hash, component_id and label (the component's number; null without shingles)."""
    marks = stored(signatures(docs, shingle), "near-signatures")
    sets_known = marks.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    grouped = sets_known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Numbers are given once and stored with the classes.
    classes = stored(grouped.withColumn("c", F.monotonically_increasing_id()), "near-classes")
    banded = classes.select("c", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("members > 1"), "near-bands")
    shared = stored(lookup(banded, "band", buckets, hot_keys(buckets, "band", "members"), ["c"]).where("members is not null"), "near-buckets")
    facts = classes.select("c", "n", "sketch")

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches leave a link possible."""
        right = pairs.join(facts.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        both = lookup(right, "a", facts.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), hot_keys(pairs, "a"), ["b"])
        return stored(both.where(may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)).select("a", "b"), "near-pairs")

    pairs = possible(stored(shared.select(F.col("low").alias("a"), F.col("c").alias("b")).where("a <> b").distinct(), "near-led"))
    wanted = classes.join(shared.select("c").distinct(), "c", "left_semi").select("c", "id", "digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")
    # An id can repeat with other texts, so a class finds its set by digest.
    sets = shingle_sets(texts, shingle).groupBy("digest").agg(F.first("set").alias("set"))
    sets = stored(wanted.select("c", "digest").join(sets, "digest").select("c", "set"), "near-sets")
    edges = stored(confirmed(pairs, sets, percent), "near-edges")
    labels = components(edges)

    def unresolved(labels: DataFrame) -> DataFrame:
        """Rows of shared, with component, of the buckets that hold several components."""
        rows = shared.where("members > 2").join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
        mixed = rows.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("rows")).where("c0 <> c1")
        mixed = stored(mixed.select("band", "rows"), "near-mixed")
        kept = lookup(rows, "band", mixed, hot_keys(mixed, "band", "rows"), ["c"]).where(F.col("rows").isNotNull()).drop("rows")
        return stored(kept, "near-rest")

    rest = unresolved(labels)
    if not rest.isEmpty():
        # Once more with the largest number as leader, for what isn't linked yet.
        again = rest.select(F.col("high").alias("a"), F.col("c").alias("b"), F.col("component").alias("label_b")).where("a <> b").distinct()
        again = stored(again, "near-led")
        own = labels.select(F.col("c").alias("a"), F.col("component").alias("label_a"))
        again = lookup(again, "a", own, hot_keys(again, "a"), ["b"]).where(F.coalesce("label_a", "a") != F.col("label_b"))
        second = stored(confirmed(possible(stored(again.select("a", "b"), "near-led")), sets, percent), "near-edges")
        edges = edges.union(second)
        labels = components(edges)
        left = unresolved(labels)
        if not left.isEmpty():
            left = left.select("band", "c", "component").join(facts, "c")
            third = stored(confirmed(stored(_within_buckets(stored(left, "near-left"), percent), "near-pairs"), sets, percent), "near-edges")
            if not third.isEmpty():
                edges = edges.union(third)
                labels = components(edges)
    linked = labels.join(classes.select("c", "id"), "c")
    smallest = stored(linked.groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("classes")), "near-smallest")
    named = lookup(linked, "component", smallest.drop("classes"), hot_keys(smallest, "component", "classes"), ["c"])
    named = classes.select("digest", "id", "c").join(named.select("c", "component", "smallest"), "c", "left")
    named = named.select("digest", F.coalesce("smallest", "id").alias("component_id"), F.coalesce("component", "c").alias("label"))
    known = marks.select("doc_id", "n_shingles", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    result = lookup(known, "digest", named, hot_keys(classes, "digest", "copies"), ["doc_id", "text_hash"])
    return result.select("doc_id", "n_shingles", "text_hash", F.coalesce("component_id", "doc_id").alias("component_id"), "label")


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= percent * |union| are linked; component_id is the smallest doc_id reachable, kept
    marks the rows it names. Null and empty texts have no shingles and stay alone, as does a null doc_id. Rows that repeat a
    doc_id are documents of their own: with equal texts they have equal results, with other texts each its own component, so both
    can be kept under one id. Other columns are left out; an empty table gives an empty result.
    """
    found = _marked(docs, shingle, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one of each component, of its smallest doc_id.

    Where a component's smallest id repeats with other texts, the row of the smaller text hash stays. Rows without doc_id stay;
    of rows that repeat a kept doc_id with equal text, empty ones too, one stays.
    """
    marks = stored(_marked(docs, shingle, percent).where(F.col("doc_id").isNotNull()), "near-marked")
    first = marks.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    kept = first.union(marks.where("label is null").select("doc_id", "text_hash").distinct())
    kept = kept.select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"))
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("__near_own", F.xxhash64(F.col("text").cast("string")))
    known = rows.join(kept, (F.col("doc_id") == F.col("__near_id")) & (F.col("__near_own") == F.col("__near_hash")), "left_semi")
    if not marks.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        known = known.dropDuplicates(["doc_id", "__near_own"])
    return known.drop("__near_own").unionByName(docs.where(F.col("doc_id").isNull()))
