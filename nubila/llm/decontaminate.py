"""Benchmark decontamination by greedy string tiling.

Documents and test items are token sequences. Item seeds, the hashes of every `least` consecutive tokens, are sent to all tasks
in blocks of bounded size; documents that share seeds with an item are tiled with it: Karp-Rabin hashing at falling search
lengths finds the longest unmarked common runs, which are marked one by one, so reordered passages are covered too. A document
leaks an item when its tiles cover at least `coverage` of the item.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import filter_arrow, map_arrow

LEAST, COVERAGE = 5, 0.8
#: Item tokens that are sent to the tasks at once.
BLOCK_TOKENS = 1_000_000
SEARCH_FROM = 20
BASE = 0x9E3779B97F4A7C15
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of a length, modulo 2**64."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, values = np.zeros(n, np.uint64), ids.astype(np.uint64) + np.uint64(1)
    for k in range(length):
        out = out * np.uint64(BASE) + values[k : k + n]
    return out ^ (out >> np.uint64(29))


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of a length has no marked token."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[length:] == total[:-length]


def _free_parts(used_item: np.ndarray, used_doc: np.ndarray, i: int, j: int, length: int, least: int) -> Iterator[tuple[int, int, int]]:
    """The runs of at least `least` tokens of a match (place in item, place in document, length) that are unmarked on both sides."""
    taken = np.concatenate([[True], used_item[i : i + length] | used_doc[j : j + length], [True]])
    edges = np.flatnonzero(taken)
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if end - begin - 1 >= least:
            yield end - begin - 1, i + begin, j + begin


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, length), always the longest unmarked match next, of equal ones the first by place.

    At each search length Karp-Rabin hashing finds the longest unmarked runs of that length or more. They are marked from a heap; of
    a run that an earlier tile cut, what is left free goes back into it. So no shorter match is marked before a longer remainder.
    """
    used_item, used_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    search = max(least, min(SEARCH_FROM, len(item), len(doc)))
    while search >= least:
        hi, hd = rolled(item, search), rolled(doc, search)
        if len(hi) and len(hd):
            places: dict[int, list[int]] = {}
            for i in np.flatnonzero(_free(used_item, search)).tolist():
                places.setdefault(int(hi[i]), []).append(i)
            open_doc = np.flatnonzero(_free(used_doc, search))
            open_doc = open_doc[np.isin(hd[open_doc], np.fromiter(places, np.uint64, len(places)))]
            heap, reached = [], {}
            for j in open_doc.tolist():
                for i in places[int(hd[j])]:
                    if reached.get(j - i, -1) > i:
                        continue  # inside a run of this diagonal that was found already
                    k = 0
                    while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not used_item[i + k] and not used_doc[j + k]:
                        k += 1
                    reached[j - i] = i + k
                    if k >= search:
                        heap.append((-k, i, j))
            heapq.heapify(heap)
            while heap:
                minus, i, j = heapq.heappop(heap)
                if used_item[i : i - minus].any() or used_doc[j : j - minus].any():
                    for k, at_item, at_doc in _free_parts(used_item, used_doc, i, j, -minus, search):
                        heapq.heappush(heap, (-k, at_item, at_doc))
                else:
                    used_item[i : i - minus] = used_doc[j : j - minus] = True
                    tiles.append((i, j, -minus))
        search = least if least < search < 2 * least else search // 2
    return tiles


class ItemBlock:
    """Items with their vocabulary and seeds, in arrays that are quick to search."""

    def __init__(self, items: list[tuple[object, str]], least: int, coverage: float):
        self.least, self.coverage, self.vocabulary = least, coverage, {}
        self.ids, self.items, seeds = [], [], {}
        for item_id, text in items:
            words = tokens(text)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        for k, item in enumerate(self.items):
            size = min(least, len(item))
            for place, h in enumerate(rolled(item, size).tolist()):
                seeds.setdefault(size, {}).setdefault(h, []).append((k, place))
        self.seeds = {size: (np.array(sorted(found), np.uint64), found) for size, found in seeds.items()}

    def leaks(self, text: str | None) -> list[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """(item id, item tokens, covered tokens, tiles) for each item that the text leaks."""
        known = self.vocabulary
        doc = np.array([known.get(w, 0) for w in tokens(text)], np.int64)
        covered: dict[int, set[int]] = {}
        for size, (hashes, found) in self.seeds.items():
            own = rolled(doc, size)
            own = own[_free(doc == 0, size)] if len(own) else own
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            for h in set(own[hashes[at] == own].tolist()):
                for k, place in found[h]:
                    covered.setdefault(k, set()).update(range(place, place + size))
        out = []
        for k in sorted(covered):
            item = self.items[k]
            # Tiles cover no more of an item than its seeds do.
            if len(covered[k]) >= self.coverage * len(item):
                tiles = greedy_tiles(item, doc, min(self.least, len(item)))
                total = sum(t[2] for t in tiles)
                if total >= self.coverage * len(item):
                    out.append((self.ids[k], len(item), total, tiles))
        return out


def item_blocks(benchmark: DataFrame, least: int, coverage: float, block_tokens: int) -> Iterator[ItemBlock]:
    """The items in blocks; only one block is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(tokens(r["text"]))
        if size >= block_tokens:
            yield ItemBlock(held, least, coverage)
            held, size = [], 0
    if held:
        yield ItemBlock(held, least, coverage)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, item_tokens, covered_tokens, coverage, tiles.

    Every document, whole, is compared with every item, in blocks of items. Null and empty texts leak nothing, items without
    tokens match nothing, items shorter than `least` must occur whole; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_tokens int, covered_tokens int, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tile = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), tile]
    names = ["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "tiles"]

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for item_id, size, total, tiles in block.leaks(text.as_py()):
                        row = (doc_id, item_id, size, total, total / size, [{"item_start": i, "doc_start": j, "length": n} for i, j, n in tiles])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)

        return run

    parts = [map_arrow(rows, search(spark.sparkContext.broadcast(b)), schema) for b in item_blocks(benchmark, least, coverage, block_tokens)]
    result = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    spark, out = docs.sparkSession, docs
    keep = lambda sent: lambda texts: [not sent.value.leaks(t) for t in texts]
    for block in item_blocks(benchmark, least, coverage, block_tokens):
        out = filter_arrow(out, "text", keep(spark.sparkContext.broadcast(block)))
    return out
