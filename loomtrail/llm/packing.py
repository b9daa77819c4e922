"""Packing of documents into windows of tokens, with lexical neighbours side by side.

Documents are encoded once to a table of ids. Each task reads a run of it and cuts it into shards of at most
``SHARD_TOKENS`` ids or ``SHARD_DOCS`` documents (a longer document is a shard of its own); a shard holds a BM25
inverted index over token ids, with document frequencies and mean length of all documents. From a seed document the
index scores all unused documents of the shard by all the seed's terms and returns the best, which fill the window greedily; the document that no
longer fits is cut, and what is left of it is the next seed. What a shard leaves over is cut into windows whose
lengths are powers of two, so no window needs padding.

Texts are encoded whole, as the tokenizers library does: the contents of its special tokens become those tokens. Null and
empty texts hold only the end id. Every row is packed, also rows without an id or with a repeated one. Other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages, ragged
from loomtrail.llm.pretokens import Ids, chunks, joined, word_pieces
from loomtrail.llm.token_files import END_ID, list_crc32, with_end

WINDOW = 4096
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 4096
#: Pre-tokens whose ids a worker keeps at most, beside a shard's index.
KEPT = 400_000
#: BM25's constants, and neighbours asked for at once.
K1, B, NEIGHBOURS = 1.2, 0.75, 16
PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"

_WORKER: dict[str, Ids] = {}


def _word_bpe(path: str) -> Ids:
    """The library's encoder, asked once per piece of a worker; a special token tells pieces apart."""
    if path not in _WORKER:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        marks = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        mark = max(marks)
        library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _WORKER[path] = Ids(joined(library, mark, marks[mark], lambda x: "<|" in x or "|>" in x), word_pieces, list(marks), library, KEPT)
    return _WORKER[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of (doc_id, text), with the end id."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_bpe(tokenizer)
        for b in batches:
            for lo, hi, texts in chunks(b.column("text")):
                ids, size = ids_of(texts)
                ends = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(with_end(ids, size, end_id).astype(np.int32)))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, ids array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, documents, and ids, over all of ``tokens``; the array is as long as the vocabulary."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, stamp, total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(2, np.int64)
        for b in batches:
            ids, size = _flat(b.column("ids"))
            total += [len(size), len(ids)]
            if len(ids) and ids.max() >= len(count):
                count = np.concatenate([count, np.zeros(int(ids.max()) + 1 - len(count), np.int64)])
                stamp = np.zeros(len(count), np.int64)
            lo = 0
            for n in size:
                own, at = ids[lo : lo + n], np.arange(n)
                stamp[own] = at
                count[own[stamp[own] == at]] += 1
                lo += n
        term = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([total, count[term]]))], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    of = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    out = np.zeros(max(of, default=-1) + 1, np.int64)
    for term, n in of.items():
        if term >= 0:
            out[term] = n
    return out, of.get(-2, 0), of.get(-1, 0)


class Index:
    """The BM25 inverted index of one shard."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> None:
        n, v = len(size), len(idf)
        key, tf = np.unique(np.repeat(np.arange(n), size) * v + ids, return_counts=True)
        doc, term = key // v, key % v
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.term = term.astype(np.int32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(v + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents by falling score, then by place; none without a shared term."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        post = ragged(self.at[terms], self.at[terms + 1] - self.at[terms])
        score = np.bincount(self.doc[post], self.weight[post], self.n)
        score[~unused] = 0
        least = np.partition(score, self.n - NEIGHBOURS)[self.n - NEIGHBOURS] if self.n > NEIGHBOURS else 0
        found = np.flatnonzero((score >= least) & (score > 0))  # all that tie at the last place
        return found[np.lexsort((found, -score[found]))][:NEIGHBOURS].tolist()


def order(size: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    unused, out, queue = np.ones(len(size), bool), [], []
    sequence, room, following, seed = 0, WINDOW, 0, -1
    while True:
        if queue:
            doc = queue.pop(0)
        elif seed >= 0 and (queue := index.neighbours(seed, unused)):
            continue
        else:
            while following < len(size) and not unused[following]:
                following += 1
            if following == len(size):
                break
            doc = seed = following
        unused[doc] = False
        start, total = 0, int(size[doc])
        while start < total:
            n = min(room, total - start)
            out.append((doc, start, n, sequence, WINDOW - room))
            start, room = start + n, room - n
            if not room:
                sequence, room, queue = sequence + 1, WINDOW, []
                seed = doc if start < total else -1
    return _binary(out, sequence) if room < WINDOW else out


def _binary(pieces: list[tuple[int, int, int, int, int]], last: int) -> list[tuple[int, int, int, int, int]]:
    """Cuts the last sequence into ones whose lengths are powers of two, longest first."""
    out = [p for p in pieces if p[3] != last]
    rest = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in rest)
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    room = sizes.pop(0) if sizes else 0
    offset = 0
    for doc, start, length, *_ in rest:
        while length:
            n = min(room, length)
            out.append((doc, start, n, last, offset))
            start, length, room, offset = start + n, length - n, room - n, offset + n
            if not room and sizes:
                last, room, offset = last + 1, sizes.pop(0), 0
    return out


def pack(tokens: DataFrame, digest: bool = False) -> DataFrame:
    """Pieces of all documents of ``tokens`` (doc_id, ids), which must be a table that is read the same way each time.

    With ``digest`` the pieces' ids are given as ids_crc32 only.
    """
    df, n_docs, n_ids = frequencies(tokens)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if n_docs else np.zeros(0)
    mean = n_ids / max(n_docs, 1)

    def shard(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        column = table["ids"].combine_chunks()
        ids, size = _flat(column)
        ends = np.cumsum(size)
        pieces = np.array(order(size, Index(ids, size, idf, mean)), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        at = ends[doc] - size[doc] + start
        for lo in range(0, len(doc), 2048):
            part = slice(lo, lo + 2048)
            flat = np.concatenate([ids[a : a + n] for a, n in zip(at[part], length[part], strict=True)])
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[part])]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().take(pa.array(doc[part])), pa.array(start[part]), pa.array(length[part]), list_crc32(own) if digest else own, pa.array(size[doc[part]]), pa.array((number << 20) + sequence[part]), pa.array(offset[part])],
                names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held, docs, total = [], 0, 0
        for b in batches:
            size = _flat(b.column("ids"))[1]
            lo = 0
            for i, n in enumerate(size.tolist()):
                if docs and (total + n > SHARD_TOKENS or docs >= SHARD_DOCS):
                    held.append(b.slice(lo, i - lo))
                    yield from shard(held, number)
                    number, held, docs, total, lo = number + 1, [], 0, 0, i
                docs, total = docs + 1, total + n
            held.append(b.slice(lo))
        if docs:
            yield from shard(held, number)

    return tokens.select("doc_id", "ids").mapInArrow(each, PIECES.replace("ids array<int>", "ids_crc32 long") if digest else PIECES)


def packed(docs: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """Pieces of all documents; their ids are in ``ids``, or with ``digest`` in ids_crc32."""
    return pack(Stages(docs.sparkSession, "packing").write(encode(docs, tokenizer), "tokens", compression="zstd"), digest)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
