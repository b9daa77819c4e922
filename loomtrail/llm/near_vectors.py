"""Near-duplicate vectors by passes over random hashes.

Each pass has its own random hyperplanes; the signs of a vector's products with them are the bits of its key. All
vectors of one pass and key form a bucket, and every two of a bucket are compared in double precision. A key has
log2(n / window) bits, so that evenly spread vectors give buckets of about ``window``. The number of passes is such
that a pair at the threshold shares a bucket with the probability ``recall``, however the vectors are spread: dense
groups only make their buckets larger. A large bucket is dealt in blocks, each two of which meet in a task of their
own. A pair counts in the first pass only in which it shares a bucket, so that links are summed up within the tasks
and never become rows; of each task only a spanning forest of its links goes on to the components.

Equal vectors are first reduced to one with a count, so groups of copies cost nothing and lose no link. Vectors that
are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different length link with
nothing. Rows without an id are left out; of rows that share an id the greatest vector is used. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages
from loomtrail.llm.components import components

KEYED = "id long, digest binary, vec array<double>"
FOUND = "a long, linked long, root long"
BUCKET = ["dim", "pass", "key"]
#: Vectors of a bucket that make a block, and rows of a block that are compared at once.
BLOCK, CHUNK = 4096, 512


def n_passes(n: int, window: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has shared a window with probability ``recall``."""
    same = 1 - math.acos(threshold) / math.pi
    met = same ** max(1.0, math.log2(max(n, 2) / window))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(met, 0.99))))


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles; None where the vector cannot link."""
    values, ends = column.values.cast(pa.float64()), column.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False)
    fine = np.concatenate([[0], np.cumsum(~np.isfinite(np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, flat)))])
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        vec = flat[lo:hi]
        out.append(vec if valid[i] and hi > lo and fine[hi] == fine[lo] and vec.any() else None)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs = _rows(b.column("vec"))
        digest = [None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in vecs]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest, pa.binary()), pa.array(vecs, pa.list_(pa.float64()))], names=["id", "digest", "vec"])


def _planes(dim: int, a_pass: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, a_pass]).standard_normal((dim, bits))


def _hashed(passes: int, bits: int, seed: int):
    """Adds each vector's keys of all passes."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec")
            size = vec.value_lengths().to_numpy()
            for dim in np.unique(size):
                at = pa.array(np.flatnonzero(size == dim))
                x = vec.take(at).flatten().to_numpy().reshape(len(at), dim)
                keys = np.stack([((x @ _planes(int(dim), p, seed, bits)) > 0) @ weights for p in range(passes)], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * passes), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("copies").take(at), vec.take(at), pa.array(np.full(len(at), dim, np.int32)), lists], names=["a", "copies", "vec", "dim", "keys"])

    return each


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (each node's least known node, itself a root) after the links u, v."""
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        if not open_.any():
            return root
        u, v = u[open_], v[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up


def _pairs(x: np.ndarray, keys: np.ndarray, copies: np.ndarray, block: np.ndarray, a_pass: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many copies each row newly links with, and the least row that it is joined with; of two blocks only pairs across."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    unit = x / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    n = len(x)
    linked, root = np.zeros(n), np.arange(n)
    split = int(np.searchsorted(block, block[-1]))  # rows are sorted by block; 0 if there is one block only
    for lo in range(0, split or n, CHUNK):
        hi = min(lo + CHUNK, split or n)
        first = split or lo
        u, v = np.nonzero(unit[lo:hi] @ unit[first:].T >= threshold)
        u, v = u + lo, v + first
        if not split:
            u, v = u[u < v], v[u < v]
        for p in range(a_pass):
            if not len(u):
                break
            new = keys[u, p] != keys[v, p]
            u, v = u[new], v[new]
        linked += np.bincount(u, copies[v], n) + np.bincount(v, copies[u], n)
        root = _unite(root, u, v)
    return linked, root


def _compared(threshold: float):
    """Rows come sorted by bucket and pair of blocks; each such group is compared as a whole."""
    names = [*BUCKET, "i", "j"]

    def out(t: pa.Table) -> pa.RecordBatch:
        n, vec, keys = t.num_rows, t["vec"].combine_chunks(), t["keys"].combine_chunks()
        a, block = t["a"].to_numpy(), t["block"].to_numpy()
        if t["i"][0] != t["j"][0] and block[0] == block[-1]:  # the other block is empty
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "linked", "root"])
        linked, root = _pairs(vec.flatten().to_numpy().reshape(n, -1), keys.flatten().to_numpy().reshape(n, -1), t["copies"].to_numpy(), block, t["pass"][0].as_py(), threshold)
        on = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(linked[on].astype(np.int64)), pa.array(a[root[on]])], names=["a", "linked", "root"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(c).to_numpy() for c in names])
            cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(marks[:, lo]):
                    yield out(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
                last = tuple(marks[:, lo])
        if held:
            yield out(pa.concat_tables(held))

    return each


def near_vectors(vectors: DataFrame, id_col: str, vec_col: str, threshold: float = 0.9, window: int = 128, recall: float = 0.995, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    stages = Stages(vectors.sparkSession, "near-vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.max("vec").alias("vec"))
    keyed = stages.write(rows.mapInArrow(_keyed, KEYED), "keyed")
    classes = stages.write(keyed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("a"), F.count("*").alias("copies"), F.any_value("vec").alias("vec")), "classes")
    n = classes.count()
    bits = max(0, int(math.log2(max(n, 1) / window))) if n > window else 0
    passes = n_passes(n, window, threshold, recall) if bits else 1
    hashed = stages.write(classes.select("a", "copies", "vec").mapInArrow(_hashed(passes, bits, seed), "a long, copies long, vec array<double>, dim int, keys array<int>"), "hashed")
    large = hashed.select("dim", F.posexplode("keys").alias("pass", "key")).groupBy(*BUCKET).count().where(F.col("count") > block)
    large = stages.write(large.select(*BUCKET, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "buckets")
    rows = hashed.select("a", "copies", "vec", "dim", "keys", F.posexplode("keys").alias("pass", "key")).join(large, BUCKET, "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select(*BUCKET, "i", "j", "block", "a", "copies", "keys", "vec").repartition(*BUCKET, "i", "j").sortWithinPartitions(*BUCKET, "i", "j", "block", "a")
    found = stages.write(dealt.mapInArrow(_compared(threshold), FOUND), "found")
    links = stages.write(found.where("a <> root").selectExpr("root as a", "a as b").distinct(), "links")
    label = components(links, stages)
    degree = found.groupBy("a").agg(F.sum("linked").alias("linked"))
    of_class = classes.select("digest", "a", "copies").join(degree, "a", "left").join(label.withColumnRenamed("node", "a"), "a", "left")
    of_class = of_class.select("digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "a").alias("component_id"))
    out = keyed.select("id", "digest").join(of_class, "digest", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return out.withColumnRenamed("id", "vec_id")
