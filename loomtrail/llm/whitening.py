"""Whitening of vectors by a tiled covariance.

An entry c becomes the integer x = floor(64 c) + 1000000; it is kept without the constant, on which no result depends.
Sums per dimension are exact. The pairs of dimensions are cut
into tiles of ``tile`` by ``tile``; rows are cut into blocks, and each block's columns into strips of ``tile``
dimensions. The strips are shuffled by row-block and tile, so that a task multiplies the two strips that a tile needs,
centred before, and sums what it has for each tile; the sums of all tasks are added per row of a tile. The d x d matrix of the
tiles is assembled on the driver, where it is decomposed (d^2 numbers of 8 bytes, at most ``MOST`` dimensions; more
raise). Rows are then projected on the leading components.

Vectors that are null, empty or hold null or non-finite entries are left out, as are entries whose x does not fit 53
bits. The fit list is all other vectors of the commonest length (the longer one at a tie); vectors of other lengths are
left out. Repeated rows count again, ids may be null or repeat, other columns are ignored. Components whose variance is
not above rounding (a constant table, or fewer rows than components) are left out, so an empty or constant table gives
no rows. A component's sign is such that its entry of the greatest size is positive; equal eigenvalues have no order of
their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages

STEP = 64
#: The least number of dimensions and the greatest number of strips, entries of a row-block, and dimensions that the driver decomposes.
TILE, STRIPS, BLOCK, MOST = 64, 8, 1 << 20, 8192
LIMIT = float(1 << 52)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The valid rows, as integers."""
    for b in batches:
        vec = b.column("vec")
        size = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = vec.flatten()
        values = np.floor(STEP * np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False).astype(np.float64)))
        bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LIMIT))])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        keep = (size > 0) & (bad[ends[1:]] == bad[ends[:-1]])
        x = values[np.repeat(keep, size)].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep)), pa.array(size[keep], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["id", "d", "x"])


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, the number of dimensions d, and x as a list."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(_whole, "id long, d int, x array<long>")


def _matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, d)


def _sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of a task's rows, exact: high and low parts of 32 bits apart."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for b in batches:
            x = _matrix(b, d)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(d, n, np.int64))], names=["dim", "high", "low", "n"])

    return each


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    found = rows.select("x").mapInArrow(_sums(d), "dim int, high long, low long, n long").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("dim").collect()
    return (found[0]["n"], [(r["high"] << 32) + r["low"] for r in found]) if found else (0, [0] * d)


def _strips(d: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The strips of each row-block, once for each tile that needs them; a block's name tells its task and number."""
    names = ["block", "i", "j", "left", "rows", "strip"]
    cuts = list(range(0, d, tile))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            x = _matrix(b, d)
            step = max(1, BLOCK // d)
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                raw = [np.ascontiguousarray(_narrow(part[:, c : c + tile])) for c in cuts]
                for i in range(len(cuts)):
                    for j in range(i, len(cuts)):
                        both = [(True, raw[i])] if i == j else [(True, raw[i]), (False, raw[j])]
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (f"{task}:{k}", i, j, left, len(part), bytes([r.dtype.itemsize]) + r.tobytes()), strict=True)) for left, r in both], schema=SCHEMA)
                k += 1

    return each


SCHEMA = pa.schema([("block", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("left", pa.bool_()), ("rows", pa.int64()), ("strip", pa.binary())])


def _narrow(x: np.ndarray) -> np.ndarray:
    """In as few bytes as its numbers need."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _wide(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(f"i{raw[0]}"), offset=1).reshape(rows, -1).astype(np.int64)


def _products(tile: int, n: int, sum_: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products of the strips that meet; rows come sorted by tile and block. ``sum_`` has one number per dimension."""
    def centred(strip: np.ndarray, k: int) -> np.ndarray:
        # n x - S is exact: the quotient is split, so that no product outgrows 64 bits
        s = sum_[k * tile : k * tile + strip.shape[1]]
        mean, rest = np.array([v // n for v in s], np.int64), np.array([v % n / n for v in s])
        return (strip - mean).astype(np.float64) - rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, block, first = None, None, None, None
        for b in batches:
            for r in b.to_pylist():
                strip = _wide(r["strip"], r["rows"])
                if (r["i"], r["j"]) != key:
                    if total is not None:
                        yield _lines(*key, total)
                    key, total = (r["i"], r["j"]), None
                if r["left"]:
                    block, first = r["block"], centred(strip, r["i"])
                if r["i"] == r["j"] or not r["left"]:
                    assert block == r["block"], "the left strip of a block comes first"
                    product = first.T @ (first if r["left"] else centred(strip, r["j"]))
                    total = product if total is None else total + product
        if total is not None:
            yield _lines(*key, total)

    return each


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each row of a tile that a task holds."""
    sums_: dict[tuple[int, int, int], np.ndarray] = {}
    for b in batches:
        for *key, s in zip(*(b.column(c).to_pylist() for c in "ijr"), b.column("sum"), strict=True):
            s = s.values.to_numpy()
            sums_[tuple(key)] = sums_[tuple(key)] + s if tuple(key) in sums_ else s
    for key, s in sums_.items():
        yield _batch([key], [s])


LINES = "i int, j int, r int, sum array<double>"


def _batch(keys: list[tuple[int, int, int]], lines: list[np.ndarray]) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.list_(pa.float64()))], names=["i", "j", "r", "sum"])


def _lines(i: int, j: int, total: np.ndarray) -> pa.RecordBatch:
    return _batch([(i, j, r) for r in range(len(total))], list(total))


def covariance(rows: DataFrame, d: int, n: int, sum_: list[int], stages: Stages, tile: int) -> np.ndarray:
    """The d x d covariance of x, with divisor n; ``sum_`` are exact sums of the same rows."""
    strips = rows.select("x").mapInArrow(_strips(d, tile), "block string, i int, j int, left boolean, rows long, strip binary")
    dealt = strips.repartition("i", "j", "block").sortWithinPartitions("i", "j", "block", F.desc("left"))
    partial = stages.write(dealt.mapInArrow(_products(tile, n, sum_), LINES), "products")
    out = np.zeros((d, d))
    for r in partial.repartition("i", "j", "r").mapInArrow(_added, LINES).collect():  # d^2 numbers in all
        a, b = r["i"] * tile + r["r"], r["j"] * tile
        out[a, b : b + len(r["sum"])] = out[b : b + len(r["sum"]), a] = np.array(r["sum"]) / n
    return out


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and their unit eigenvectors as columns; those at rounding are left out."""
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    keep = value > max(len(cov) * np.finfo(float).eps * max(value[0], 0), 0) * 16
    value, vector = value[keep], vector[:, keep]
    return value, vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])


def _projected(d: int, n: int, sum_: list[int], value: np.ndarray, vector: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, exact deviation as decimal text, and the whitened row."""
    mean, rest = np.array([v // n for v in sum_], np.int64), np.array([v % n / n for v in sum_])
    remainder = [v % n for v in sum_]
    own = np.array(remainder, np.int64) if n < 1 << 62 else None
    scaled = vector / np.sqrt(value)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, d) - mean
            most = int(np.abs(x).max(initial=0) + 1) * n
            if own is not None and most * most * d < 1 << 63:
                deviation = [str(v) for v in ((n * x - own) ** 2).sum(axis=1).tolist()]
            else:
                deviation = [str(sum((n * v - r) ** 2 for v, r in zip(row, remainder, strict=True))) for row in x.tolist()]
            y = (x.astype(np.float64) - rest) @ scaled
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))], names=["id", "deviation", "whitened"])

    return each


def _moments(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n = np.zeros(k), np.zeros((k, k)), 0
        for b in batches:
            y = b.column("whitened").flatten().to_numpy().reshape(b.num_rows, k)
            first, second, n = first + y.sum(axis=0), second + y.T @ y, n + len(y)
        if n:
            yield _lines(0, 0, np.vstack([first, second]))

    return each


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity."""
    found = white.select("whitened").mapInArrow(_moments(k), LINES).repartition("i", "j", "r").mapInArrow(_added, LINES)
    first, *second = (r["sum"] for r in found.orderBy("r").collect())  # k + 1 rows of k numbers
    mean = np.array(first) / n
    return float(np.abs(np.array(second) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32, tile: int | None = None) -> DataFrame:
    """A row per vector: id, n, deviation (decimal), whitened (list), explained (list, the same in each row) and identity_error."""
    stages = Stages(vectors.sparkSession, "whitening")
    schema = "id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = stages.write(integers(vectors, id_col, vec_col), "integers")
    size = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, rows = size["d"], rows.where(F.col("d") == size["d"])
    if d > MOST:
        raise ValueError(f"{d} dimensions; at most {MOST} are decomposed")
    n, sum_ = sums(rows, d)
    cov = covariance(rows, d, n, sum_, stages, tile or max(TILE, -(-d // STRIPS)))
    value, vector = components(cov, most)
    if not len(value):
        return vectors.sparkSession.createDataFrame([], schema)
    white = stages.write(rows.select("id", "x").mapInArrow(_projected(d, n, sum_, value, vector), "id long, deviation string, whitened array<double>"), "whitened")
    error = identity_error(white, n, len(value))
    explained = F.array(*(F.lit(float(v)) for v in value / np.trace(cov)))
    return white.select("id", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    out = white.select(F.col("id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
