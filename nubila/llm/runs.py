"""Periodic runs of words, by Lyndon words.

A run is a stretch with smallest period q that no neighbouring word extends. Every run whose words repeat twice or more holds a
Lyndon word of length q that is the longest one at its place under one of the two orders of words (the order in which the word
after the run is smaller than the word a period before it). So one scan from right to left under each order, with a stack of next
smaller suffixes, proposes for every place one period; common prefixes and suffixes then extend it. Suffixes are compared by their
first words, then by rolling hashes and binary search; what is reported has been compared word by word.

Only stretches that can hold a run are scanned. In a run of length l >= max(6, 4 q), the three words at each of its first l - q - 2
places come again q words later. Places whose three words don't come again near enough thus part a text into windows, and each run
lies whole inside one window. This leaves no run out; ordinary prose has hardly any window, and periodic text is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import map_arrow

WORD = re.compile("[^ \t-\r]+")
#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rolling hash: a prime and a base below it; a random number of about half its size.
PRIME, BASE = (1 << 61) - 1, 1_234_567_890_123_456_789
#: Rounds that narrow the windows, at most: they only save work.
NARROW = 8


class Common:
    """Common prefixes and suffixes of the stretches at two places of a sequence of numbers, by rolling hashes."""

    powers = [1]

    def __init__(self, codes: list[int]):
        self.codes, n = codes, len(codes)
        h, hashes = 0, [0]
        for c in codes:
            h = (h * BASE + c + 1) % PRIME
            hashes.append(h)
        self.hashes = hashes
        while len(self.powers) <= n:
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def equal(self, i: int, j: int, size: int) -> bool:
        """Whether so many words from i and from j agree."""
        h, p = self.hashes, self.powers[size]
        return (h[i + size] - h[j + size] - (h[i] - h[j]) * p) % PRIME == 0

    def _longest(self, most: int, agree) -> int:
        """The greatest size up to most for which agree(size) holds: doubled until it fails, then halved."""
        low, step = 0, 4
        while low + step <= most and agree(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if agree(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def prefix(self, i: int, j: int) -> int:
        """Words in common from i and from j on, i < j."""
        return self._longest(len(self.codes) - j, lambda size: self.equal(i, j, size))

    def suffix(self, i: int, j: int) -> int:
        """Words in common before i and before j, i < j."""
        return self._longest(i, lambda size: self.equal(i - size, j - size, size))


def next_smaller(codes: list[int], common: Common) -> list[int]:
    """For each place the next one whose suffix is smaller, or the end: the longest Lyndon word at a place ends before it.

    `codes` gives the order; those of `common` may be others with the same equalities. A suffix that ends inside another is smaller.
    """
    n, stack = len(codes), []
    out = [n] * n
    for i in range(n - 1, -1, -1):
        own = codes[i]
        while stack:
            j = stack[-1]
            if own == codes[j]:
                size = common.prefix(i, j)
                if j + size >= n or codes[i + size] > codes[j + size]:
                    break
            elif own > codes[j]:
                break
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def windows(codes: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint or overlapping stretches of which each run lies whole in one."""
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    kinds = int(codes.max()) + 1
    pairs, width = codes[:-1] * kinds + codes[1:], kinds * kinds
    if kinds >= 1 << 21:  # three codes don't fit one number
        pairs = np.unique(pairs, return_inverse=True)[1]
        width = n
    keys = codes[:-2] * width + pairs[1:]
    order = np.argsort(keys, kind="stable")
    ahead = np.diff(order)
    gap = np.full(len(keys), n, dtype=np.int64)
    again = np.diff(keys[order]) == 0
    gap[order[:-1][again]] = ahead[again]
    alive = gap * LEAST_PERIODS <= n
    starts = ends = np.empty(0, dtype=np.int64)
    for _ in range(NARROW):
        turns = np.diff(np.concatenate(([0], alive.view(np.int8), [0])))
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if not len(starts):
            return []
        most = np.where(ends - starts >= LEAST_WORDS - 3, (ends - starts + 2) // 3, 0)
        narrower = alive.copy()
        narrower[alive] = gap[alive] <= np.repeat(most, ends - starts)
        if (narrower == alive).all():
            break
        alive = narrower
    return [(a, min(n, b + (b - a + 2) // 3 + 2)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= LEAST_WORDS - 3]


def find_runs(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start, then period."""
    ids: dict[str, int] = {}
    coded = [ids.setdefault(w, len(ids)) for w in words]
    codes, found = np.array(coded, dtype=np.int64), set()
    for low, high in windows(codes):
        part = coded[low:high]
        n, common = len(part), Common(part)
        for order in (part, [-c for c in part]):
            within: dict[int, tuple[int, int]] = {}
            for i, end in reversed(list(enumerate(next_smaller(order, common)))):
                q = end - i
                # The leftmost Lyndon word of a run of four periods begins in the first one: two more follow it.
                if i + 3 * q > n or part[i] != part[end]:
                    continue
                s, e = within.get(q, (n, n))
                if (s <= i and end <= e) or not common.equal(i, end, 2 * q):
                    continue
                s, e = i - common.suffix(i, end), end + common.prefix(i, end)
                within[q] = s, e
                if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.add((low + s, e - s, q))
    n = len(coded)
    runs: dict[tuple[int, int], int] = {}
    for s, size, q in found:
        e = s + size
        if not np.array_equal(codes[s : e - q], codes[s + q : e]):  # one hash for different words: the same by direct comparison
            i, apart = (s + e - q) // 2, np.flatnonzero(codes[:-q] != codes[q:])
            s, e = int(max(apart[apart < i], default=-1)) + 1, int(min(apart[apart >= i], default=n - q)) + q
        # A stretch cut by a window's end is part of a run that lies whole in another window.
        if not ((s and coded[s - 1] == coded[s - 1 + q]) or (e < n and coded[e] == coded[e - q])) and e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
            runs[s, e - s] = min(q, runs.get((s, e - s), q))
    return sorted(((s, size, q) for (s, size), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return list(words)
    keep = np.ones(len(words), dtype=bool)
    for start, size, q in runs:
        keep[start + q : start + size] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, runs (start, length, period; by start, then period) and the text collapsed, its words one space apart.

    Null and empty texts, and texts without words, have no runs and collapse to an empty text. Repeated rows give repeated rows;
    other columns are left out. A text is read whole, by one task; work grows with its words times their logarithm.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text or "")
                own = find_runs(words)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(kind)), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, scan, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
