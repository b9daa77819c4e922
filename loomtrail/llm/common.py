"""Shared helpers: stage tables in the cluster's shared folder, and vectorised word and byte hashing.

Ids: operators that need one row per document go through ``one_row_per_id``: rows without an id are left out,
and of rows that share an id the one with the greatest text is used. Row-wise operators keep every row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash and of the final mixes (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB
#: Bytes of text that are hashed at once inside a task.
SPAN = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode where none is set, as in tests."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomtrail-")
        spark.sparkContext.setCheckpointDir(found)
    return str(found).rstrip("/")


class Stages:
    """Tables written between the steps of an operator, which cut its lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with one row per id that is not null; shuffles texts only if some id repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull())
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else rows


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; kept by the worker."""
    if len(_POWERS.get("up", ())) <= n:
        for name, step in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(n + 1, step, np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Polynomial hashes of any byte ranges of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(MIX2))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(offsets: np.ndarray, most: int = SPAN) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = hi
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other bytes of UTF-8 stay."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than 0x20 and 0x09-0x0D; a row's end also ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each k-word shingle of lower-cased text; a row of fewer words has one, of all its words.

    Also the way the words are cut: the third value indexes ``words``.
    """
    data = lower(data)
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), row, row
    word = Prefix(data).of(start, end)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    at = np.arange(len(word))
    room = first[row] + per_row[row] - at
    keep = (room >= k) | ((per_row[row] < k) & (at == first[row]))
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    out = np.zeros(len(word), np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + np.where(room > i, padded[i : i + len(word)], np.uint64(i + 1))
    return mix(out[keep]), row[keep], at[keep]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same for each further range."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - before, size)


def as_bytes(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each number, a row each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width])


def from_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64).reshape(-1)


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte place, so that the equal high bytes of small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _numbers(raw: pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packed(part: np.ndarray, cols: list[np.ndarray], raws: list[np.ndarray]) -> pa.RecordBatch:
    """A row per part: its entries' numbers, as differences from one entry to the next (c0, ...), and their bytes (r0, ...)."""
    part = part.astype(np.uint16 if not len(part) or part.max() < 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    cuts = list(zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=False))
    out = [[_planes(np.diff(c[i:j], prepend=c.dtype.type(0))) for i, j in cuts] for c in (c[order] for c in cols)]
    out += [[r[i:j].tobytes() for i, j in cuts] for r in (r[order] for r in raws)]
    names = ["part", *(f"c{k}" for k in range(len(cols))), *(f"r{k}" for k in range(len(raws)))]
    return pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), *(pa.array(c, pa.binary()) for c in out)], names=names)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type], widths: list[int]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Each part with its entries; rows come sorted by part."""
    held: list[list[np.ndarray]] = []
    last = None

    def out() -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        return last, whole[: len(kinds)], whole[len(kinds) :]

    for b in batches:
        for i, part in enumerate(b.column("part").to_pylist()):
            if held and part != last:
                yield out()
                held = []
            cols = [np.cumsum(_numbers(b.column(f"c{k}")[i].as_buffer(), kind), dtype=kind) for k, kind in enumerate(kinds)]
            held.append(cols + [np.frombuffer(b.column(f"r{k}")[i].as_buffer(), np.uint8).reshape(-1, width) for k, width in enumerate(widths)])
            last = part
    if held:
        yield out()


#: Bits of the filter of ids (a power of two), and of one row of its table.
FILTER_BITS, CHUNK_BITS = 1 << 27, 1 << 15


def _bitmap(per: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(b.column("at").to_numpy())
            chunk, word, bit = at // per, at % per >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(at) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = words.setdefault(int(chunk[lo]), np.zeros(per >> 6, np.uint64))
                np.bitwise_or.at(own, word[lo:hi], bit[lo:hi])
        for k, own in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["__q_chunk", "__q_words"])

    return each


def id_filter(ids: DataFrame, stages: Stages, name: str, bits: int = FILTER_BITS, per: int = CHUNK_BITS) -> DataFrame:
    """A bitmap of the hashes of a column of ids: 16 MB at any number of ids, so it may be broadcast.

    Few ids leave few others through; with more than the bits can tell apart it lets all through. Joins settle what passes.
    """
    at = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(bits)).alias("at")).distinct()
    chunks = at.repartition(F.floor(F.col("at") / per)).mapInArrow(_bitmap(per), "__q_chunk long, __q_words array<long>")
    return stages.write(chunks, name)


def with_marks(df: DataFrame, ident: Column, chunks: DataFrame, bits: int = FILTER_BITS, per: int = CHUNK_BITS) -> DataFrame:
    """Adds ``__q_in``: false where an id is certainly not in the filter; no row is shuffled."""
    at = F.pmod(F.xxhash64(ident.cast("long")), F.lit(bits))
    both = df.join(F.broadcast(chunks), F.floor(at / per) == F.col("__q_chunk"), "left")
    bit = F.getbit(F.get("__q_words", F.shiftright(F.pmod(at, F.lit(per)), 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    return both.select(*(df[c] for c in df.columns), (F.coalesce(bit, F.lit(False)) & ident.isNotNull()).alias("__q_in"))
