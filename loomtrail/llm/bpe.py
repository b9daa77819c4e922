"""Byte-level BPE by ranks, with a queue of ranks that is a hierarchy of bitmaps.

A pre-token's bytes form a linked list. Each pair of neighbours whose concatenation has a rank lies in the bucket of
that rank; a bitmap of 256-bit words marks the buckets in use, and one above it marks the words in use, so
find-first-set from the top gives the least rank in two steps at any length. A bucket's positions are taken from
left to right; entries whose pair has changed since are skipped. Time grows linearly with the pre-token but for the
sort within buckets, so one that fills a whole document is no special case.

Null and empty texts have no ids. Rows are encoded one by one: repeated rows and ids get equal results, an empty
table gives none, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.pretokens import Ids, chunks, gpt_pieces


BIT = [1 << i for i in range(256)]


class RankQueue:
    """Buckets of positions by rank; bitmaps of 256-bit words, and one over the words, tell the least rank in use."""

    def __init__(self, n: int) -> None:
        self.words = [0] * ((n >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.words[word] |= BIT[rank & 255]
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The least rank in use and its positions, which it gives up; (-1, []) if none is."""
        top = self.top
        if not top:
            return -1, []
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


def merge(data: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token; ``queue`` is empty before and after."""
    n = len(data)
    if data in ranks:  # the last merge of a whole token is itself
        return [ranks[data]]
    get = ranks.get
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [-1] * n  # rank of the pair that starts here; -1 where there is none or the position is merged away
    for i in range(n - 1):
        rank = get(data[i : i + 2])
        if rank is not None:
            pair[i] = rank
            queue.push(rank, i)
    while queue.top:
        rank, found = queue.take()
        found.sort()
        for k, i in enumerate(found):
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            pair[gone] = -1
            after[i] = end
            low = rank
            if end < n:
                ahead[end] = i
                new = get(data[i : after[end]], -1)
                pair[i] = new
                if new >= 0:
                    queue.push(new, i)
                    low = min(low, new)
            else:
                pair[i] = -1
            if (p := ahead[i]) >= 0:
                new = get(data[p:end], -1)
                pair[p] = new
                if new >= 0:
                    queue.push(new, p)
                    low = min(low, new)
            if low < rank:  # a lower rank came up: it goes first
                for j in found[k + 1 :]:
                    queue.push(rank, j)
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a file of ranks."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.ids_of = Ids(self.merged, gpt_pieces)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [merge(x.encode(), self.ranks, self.queue) for x in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(size.sum())), size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        return self.ids_of(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_WORKER: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _WORKER:
        with open(path, "rb") as file:
            _WORKER[path] = Codec(file.read())
    return _WORKER[path]


def bpe_encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (list of int) of each text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks)
        for b in batches:
            for lo, hi, texts in chunks(b.column("text")):
                ids, size = coder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, the sha256 of the ids as decimal text, and the decoded bytes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks)
        decimal = [str(i) for i in range(len(coder.bytes_of))]
        for b in batches:
            size, digest, data, held, lo = [], [], [], 0, 0
            for k, ids in enumerate(b.column("ids")):
                ids = ids.values.to_pylist() if ids.is_valid else []
                size.append(len(ids))
                digest.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                data.append(coder.decode(ids))
                held += len(data[-1])
                if held > 16 << 20 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo : k + 1], pa.array(size, pa.int64()), pa.array(digest), pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "ids_sha256", "decoded"])
                    size, digest, data, held, lo = [], [], [], 0, k + 1

    rows = tokens.select(F.col(id_col).alias("doc_id"), "ids")
    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
