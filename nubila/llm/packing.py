"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document is tokenised once. Documents longer than a sequence are cut into full pieces; the first piece takes the
remainder. Pieces are dealt by hash into shards of about `shard_pieces`, so no shard grows with the input, and each shard is
packed on its own: pieces come longest first, and each goes where the sum over residual gaps g of (open bins with gap g)^2
becomes smallest. A shard of thousands of pieces ends within a few sequences of the sum of its lengths.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import cached, map_arrow, stored

# The pre-tokenisation pattern of the public byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with an unbroken run this long go to the slower encoder, whose merging is not quadratic.
LONG_RUN = 400


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from text to ids as a numpy array, equal to `tokenizers` on the same file.

    The file's vocabulary drives a fast rank-merging encoder; texts with very long unbroken runs, and texts with one of the
    file's special strings, which `tokenizers` makes their own ids, take `tokenizers` itself.
    """

    def make():
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(path)
        run = re.compile("|".join([rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}", *map(re.escape, sorted(special))]))

        def encode(text: str) -> np.ndarray:
            if run.search(text):
                return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)

        return encode

    return cached(("encoder", path), make)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with `keep_ids`, ids.

    Null text is empty text, whose only token is the closing `end_id`. Repeated rows are pieces of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                first = (len(ids) - 1) % max_tokens + 1
                begin = 0
                for piece in range(1 + (len(ids) - first) // max_tokens):
                    part = ids[begin : (first if piece == 0 else begin + max_tokens)]
                    values = (doc_id, piece, begin, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.tolist() if keep_ids else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    begin += len(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows[:n], kinds, strict=False)], names=names[:n])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    Placing a piece of length s into a bin of gap g changes the sum of squared counts by 2(N[g-s] - N[g]) + 2, closing a bin
    by 1 - 2 N[g]. The least change wins, then the smaller gap. A bin is opened only if the piece fits none: opening one while
    others have room also lowers the sum at times, but ends with more sequences.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    never, made = np.int64(1) << 60, 0
    for i, s in enumerate(map(int, lengths)):
        there = counts[s:capacity]
        gap = capacity
        if there.size:
            change = np.where(there > 0, 2 * (counts[: capacity - s] - there) + 2, never)
            if there[0] > 0:
                change[0] = 1 - 2 * there[0]
            best = int(change.argmin())
            if change[best] < never:
                gap = s + best
        if gap == capacity:
            target, made = made, made + 1
        else:
            target = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = target, capacity - gap
        if gap > s:
            open_bins[gap - s].append(target)
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int, shards: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Pieces are dealt by hash of doc_id and place, and of their row, so rows that repeat a doc_id don't meet in one shard.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    columns = pieces.columns

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), max_tokens)
        return pdf[columns].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    dealt = pieces.withColumn("__shard", shard)
    return dealt.groupBy("__shard").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, keep_ids: bool = False, shard_pieces: int = 8192) -> DataFrame:
    """Packs every document into sequences of at most `max_tokens` tokens.

    Returns doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset. An empty table gives an empty result; null
    and empty texts are one closing token; ties of length go by doc_id and piece; other columns of `docs` are left out. Pieces are
    stored, so texts are tokenised once and shards are counted from pieces, however long the documents are.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, max_tokens, end_id, keep_ids), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    return pack(pieces, max_tokens, shards)
