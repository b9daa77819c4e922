"""Near-duplicate documents by n-gram Jaccard similarity, with prefixes that must match several times.

A document is the set of hashes of its five-word shingles. Two sets with a Jaccard similarity of at least t share at
least ceil(t * n) elements of each one's n, so in any order of all shingles the first n - ceil(t * n) + l elements of
either hold l shared ones: a longer prefix must match more often before a pair is worth a check. This is used twice.

1. In the order of the hashes, prefixes with l = 1 + 0.15 * n: of each block of documents one entry per shingle goes to
   the shingle's bucket, which tells blocks what other blocks hold too. Documents whose prefix holds too few repeated
   shingles have no partner. This is exact, and moves two fifths of the shingles once, packed.
2. Equal sets become one. Of the rest each block learns how many documents hold its shingles; fewer repeated ones than
   ceil(t * n) again mean no partner. In the order of these counts, rare first, each document picks the l that costs
   least by the lengths of the lists its prefix would meet.

Candidates are checked on whole sets. As a group of near copies is one component, its pairs need not all be checked:
each round a document is held against the member of another component that it shares most with, components are
merged, and when few of these checks give links any more, all pairs left across components are checked that share
min(l, l') elements, at places and of sizes that leave room for the threshold. Pairs within a component change nothing and are never made.

Null and empty texts have no shingles and are linked with nothing; a text of fewer than five words is one shingle. Rows
without an id are left out, and of rows that share an id the greatest text is used. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages, buffers, one_row_per_id, shingles, spans
from loomtrail.llm.components import components

PERCENT, WORDS = 75, 5
#: Multiple matches that a document may ask for, and the cost of a check against that of a list entry.
MOST_MATCHES, CHECK_COST = 8, 8
#: Shingles of a block, and pivot rounds at most before all pairs across components are checked.
BLOCK, ROUNDS = 400_000, 10
#: Pivot rounds go on while this share of the pairs checked gives links.
LEAST_GAIN = 0.2
#: Entries of a prefix that travel with each of them to the last join; pairs with a longer one are all checked, so rows stay bounded.
FRONT = 256


def least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def matches(n: np.ndarray) -> np.ndarray:
    return 1 + 15 * n // 100


def distinct_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows, sorted within each row and without repeats, and their number per row."""
    h, row, _ = shingles(data, offsets, words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.bincount(row[keep], minlength=len(offsets) - 1)


def pack48(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash as six bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def unpack48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash's bucket, from bits in the middle: those above give its order."""
    return ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % n


def _batch(names: str, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    kinds = {"block": pa.int64(), "idx": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "own": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names.split()], names=names.split())


FIRST = "block idx doc_id n own bucket blob"


def _prefixes(percent: int, words: int, n_buckets: int):
    """A row per document, with the repeats that its block knows of, and a row per bucket of each block's prefix shingles."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for lo, hi in spans(offsets):
                h, n = distinct_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                row = np.repeat(np.arange(hi - lo), n)
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = rank < (n - least(n, percent) + matches(n))[row]
                h, row = h[keep], row[keep]
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                count = np.diff(np.append(np.flatnonzero(head), len(h)))
                again = np.repeat(count > 1, count)
                yield _batch(FIRST, block=[block] * (hi - lo), idx=np.arange(hi - lo), doc_id=b.column("doc_id")[lo:hi], n=n, own=np.bincount(row[again], minlength=hi - lo))
                one, where = h[head], np.where(count > 1, 0xFFFF, row[head])
                bucket = buckets_of(one, n_buckets)
                order = np.argsort(bucket, kind="stable")
                raw = np.concatenate([pack48(one[order]), where[order].astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    yield _batch(FIRST, block=[block] * len(full), bucket=full, blob=[raw[cuts[k] : cuts[k + 1]].tobytes() for k in full])
                block += 1

    return each


def _by_bucket(work, names: str):
    """Hands all blobs of a bucket, with their blocks, to ``work``; the rows come sorted by bucket."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, blobs = None, [], []
        for b in batches:
            for bucket, block, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "blob")), strict=True):
                if bucket != now and blobs:
                    yield _batch(names, **work(blocks, blobs))
                    blocks, blobs = [], []
                now = bucket
                blocks.append(block)
                blobs.append(blob)
        if blobs:
            yield _batch(names, **work(blocks, blobs))

    return each


def _table(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    return raw, np.repeat(np.arange(len(blobs)), [len(x) // width for x in blobs])


def _repeated(blocks: list[int], blobs: list[bytes]) -> dict:
    """For each block the documents whose shingles some other block holds too, once per shingle, as 16-bit places."""
    raw, source = _table(blobs, 8)
    h, where = unpack48(raw[:, :6]), raw[:, 6:].copy().view("<u2").ravel()
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again &= where != 0xFFFF
    source, where = source[again], where[again]
    cuts = np.searchsorted(source, np.arange(len(blobs) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return {"block": [blocks[k] for k in full], "blob": [where[cuts[k] : cuts[k + 1]].tobytes() for k in full]}


def survivors(docs: DataFrame, stages: Stages, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of all documents, and the ids of those that may have a partner."""
    n_buckets = max(64, min(docs.count() // 4096, 100_000))
    first = stages.write(docs.mapInArrow(_prefixes(percent, words, n_buckets), "block long, idx int, doc_id long, n long, own long, bucket int, blob binary"), "prefixes")
    dealt = first.where("bucket is not null").select("bucket", "block", "blob").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(_by_bucket(_repeated, "block blob"), "block long, blob binary")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.bincount(np.frombuffer(b"".join(pdf["blob"]), "<u2"))
        idx = np.flatnonzero(count)
        return pd.DataFrame({"block": np.full(len(idx), pdf["block"].iloc[0]), "idx": idx.astype(np.int32), "others": count[idx]})

    counts = told.groupBy("block").applyInPandas(total, "block long, idx int, others long")
    rows = first.where("doc_id is not null").select("block", "idx", "doc_id", "n", "own")
    joined = rows.join(counts, ["block", "idx"], "left").withColumn("found", F.col("own") + F.coalesce("others", F.lit(0)))
    smallest = F.ceil(F.col("n") * percent / 100)
    needed = 1 + F.floor(smallest * 15 / 100)
    out = stages.write(joined.select("doc_id", "n", ((F.col("n") > 0) & (F.col("found") >= needed)).alias("live")), "sizes")
    stages.drop("prefixes")
    return out.select("doc_id", "n"), out.where("live").select("doc_id")


def _sets(words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for lo, hi in spans(offsets):
                h, n = distinct_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                raw, ends = h.astype("<u8").tobytes(), 8 * np.concatenate([[0], np.cumsum(n)])
                sets = [raw[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "set"])

    return each


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers blocks of sets."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        size = np.cumsum([len(x.as_buffer()) // 8 for x in b.column("set")], dtype=np.int64)
        number = block + (held + size) // BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(number), b.column("doc_id"), b.column("set")], names=["block", "doc_id", "set"])
        held += int(size[-1]) if len(size) else 0


def _counts(n_buckets: int):
    """A row per bucket of each block: its shingles, each with the number of the block's documents that hold it."""
    def out(block: int, sets: list[bytes]) -> pa.RecordBatch:
        h, count = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_counts=True)
        bucket = buckets_of(h, n_buckets)
        order = np.argsort(bucket, kind="stable")
        raw = np.concatenate([pack48(h[order]), count[order].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        return _batch("block bucket blob", block=[block] * len(full), bucket=full, blob=[raw[cuts[k] : cuts[k + 1]].tobytes() for k in full])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("set").to_pylist(), strict=True):
                if block != now and held:
                    yield out(now, held)
                    held = []
                now = block
                held.append(raw)
        if held:
            yield out(now, held)

    return each


def _summed(blocks: list[int], blobs: list[bytes]) -> dict:
    """For each block its shingles that two documents or more hold, with the number of all that do."""
    raw, source = _table(blobs, 10)
    h, count = unpack48(raw[:, :6]), raw[:, 6:].copy().view("<u4").ravel().astype(np.int64)
    _, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, count).astype(np.int64)[back]
    again = total > 1
    raw, source, total = raw[again, :6], source[again], np.minimum(total[again], 0xFFFFFFFF)
    out = np.concatenate([raw, total.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    cuts = np.searchsorted(source, np.arange(len(blobs) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return {"block": [blocks[k] for k in full], "blob": [out[cuts[k] : cuts[k + 1]].tobytes() for k in full]}


def adaptive(df: np.ndarray, alone: int, n: int, percent: int) -> tuple[int, int]:
    """How often to match, and how many of the repeated shingles (counts ``df``, rare first) the prefix then holds."""
    short = n - int(least(np.int64(n), percent)) - alone  # of the prefix without the shingles that are this document's alone
    best = None
    for l in range(1, MOST_MATCHES + 1):
        size = short + l
        if size > len(df):
            break
        lists = int((df[:size] - 1).sum())
        cost = lists * (1 + CHECK_COST / l)
        if best is None or cost < best[0]:
            best = (cost, l, size)
    return best[1:] if best else (1, 0)


def _postings(percent: int):
    """Prefix entries of a block's documents, from the counts that it was told."""
    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["blob"].notna()
        raw = np.frombuffer(b"".join(pdf["blob"][told]), np.uint8).reshape(-1, 10)
        h, df = unpack48(raw[:, :6]), raw[:, 6:].copy().view("<u4").ravel().astype(np.int64)
        h, first = np.unique(h, return_index=True)
        df = df[first]
        rows = []
        for doc, own in zip(pdf["doc_id"][~told], pdf["set"][~told], strict=True):
            own = np.frombuffer(own, "<u8") >> np.uint64(16)
            n = len(own)
            at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
            known = h[at] == own if len(h) else np.zeros(n, bool)
            if known.sum() < least(np.int64(n), percent):
                continue
            token, count = own[known], df[at[known]]
            order = np.lexsort((token, count))
            l, size = adaptive(count[order], n - len(token), n, percent)
            rows.append((doc, n, l, len(token), token[order[:size]]))
        size = np.array([len(r[-1]) for r in rows], np.int64)
        flat = np.concatenate([r[-1] for r in rows]) if rows else np.zeros(0, np.uint64)
        return pd.DataFrame({"token": flat.astype(np.int64), **{c: np.repeat(np.array([r[k] for r in rows], np.int64), size) for k, c in enumerate(("doc_id", "n", "l", "known"))}, "behind": np.concatenate([r[3] - np.arange(len(r[-1])) for r in rows]) if rows else size})

    return each


def _verified(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], names=["a", "b"])

    return each


def links(sets: DataFrame, posts: DataFrame, stages: Stages, percent: int) -> DataFrame | None:
    """Links between documents with different sets that connect every component; None without any."""
    of = sets.select("doc_id", "set")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return stages.write(full.mapInArrow(_verified(percent), "a long, b long"), name)

    found, tested, label, gain = None, None, None, 1.0
    # a document's whole prefix, as the lower halves of its hashes; ``twins`` are those lost as their halves are equal
    fronts = posts.groupBy("doc_id").agg(F.max("known").alias("_k"), F.count("*").alias("_n"), F.collect_set(F.col("token").bitwiseAND(0x7FFFFFFF).cast("int")).alias("front"))
    fronts = fronts.select("doc_id", (F.col("_k") - F.size("front")).alias("rest"), (F.col("_n") - F.size("front")).alias("twins"), F.when(F.size("front") <= FRONT, F.col("front")).alias("front"))
    for k in range(ROUNDS + 1):
        own = posts.withColumn("part", F.col("doc_id")) if label is None else posts.join(label.toDF("doc_id", "c"), "doc_id", "left").withColumn("part", F.coalesce("c", "doc_id")).drop("c")
        parts = own.groupBy("token", "part").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64(F.lit(k), "doc_id").alias("h"), "doc_id")).alias("pick"))
        mixed = parts.groupBy("token").agg(F.max(F.struct("m", (-F.col("part")).alias("p"), F.col("pick.doc_id").alias("pivot"))).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
        own = own.join(mixed.selectExpr("token", "top.pivot", "-top.p as top_part"), "token")
        posts = stages.write(own.drop("pivot", "top_part", "part"), f"posts-{k}")  # the others can link nothing new
        if posts.isEmpty():
            break
        last = k == ROUNDS or gain < LEAST_GAIN
        if last:
            own = own.join(fronts, "doc_id")
            a, b = (own.select(*(F.col(c).alias(f"{c}{s}") for c in ("token", "doc_id", "n", "l", "part", "known", "behind", "rest", "twins", "front"))) for s in "ab")
            # the l-th shared element has l - 1 before it and no more than the rest of either document from it on
            room = F.least("behinda", "behindb") + F.least("la", "lb") - 1
            near = (F.col("doc_ida") < F.col("doc_idb")) & (F.col("parta") != F.col("partb")) & ((100 + percent) * F.least("knowna", "knownb", room) >= percent * (F.col("na") + F.col("nb")))
            # beyond the prefix that ends first in the common order, no more than the rest of its document can agree
            shared = F.size(F.array_intersect("fronta", "frontb"))
            enough = (shared + F.least("twinsa", "twinsb") >= F.least("la", "lb")) & ((100 + percent) * (shared + F.greatest("resta", "restb")) >= percent * (F.col("na") + F.col("nb")))
            enough = F.when(F.col("fronta").isNull() | F.col("frontb").isNull(), F.lit(True)).otherwise(enough)
            pairs = a.join(b, (F.col("tokena") == F.col("tokenb")) & near & enough).select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")).distinct()
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        else:
            pairs = own.where("part <> top_part").groupBy("doc_id", "pivot").agg(F.count("*").alias("shared")).select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"), "doc_id", "shared")
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("doc_id").agg(F.max_by(F.struct("a", "b"), F.struct("shared", F.xxhash64("a", "b"))).alias("p")).select("p.a", "p.b").distinct()
        pairs = stages.write(pairs, f"pairs-{k}")
        new = check(pairs, f"links-{k}")
        found = new if found is None else found.union(new)
        if last:
            break
        gain = new.count() / max(pairs.count(), 1)
        tested = pairs if tested is None else tested.union(pairs)
        label = stages.write(components(found, stages, f"label-{k}"), f"label-{k}")
    return found


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    stages = Stages(docs.sparkSession, "ngram-join")
    docs = one_row_per_id(docs, id_col, text_col)
    sizes, live = survivors(docs, stages, percent, words)
    sets = stages.write(docs.join(live, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, digest binary, set binary"), "sets")
    classes = stages.write(sets.groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
    single = sets.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "set")
    single = stages.write(single.mapInArrow(_blocked, "block long, doc_id long, set binary"), "single")
    n_buckets = max(64, min(sizes.count() // 4096, 100_000))
    dealt = single.select("block", "set").mapInArrow(_counts(n_buckets), "block long, bucket int, blob binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    told = dealt.select("bucket", "block", "blob").mapInArrow(_by_bucket(_summed, "block blob"), "block long, blob binary")
    none = F.lit(None)
    rows = single.select("block", "doc_id", "set", none.cast("binary").alias("blob")).union(told.select("block", none.cast("long"), none.cast("binary"), "blob"))
    posts = stages.write(rows.groupBy("block").applyInPandas(_postings(percent), "token long, doc_id long, n long, l long, known long, behind long"), "posts")
    found = links(single, posts, stages, percent)
    member = sets.select("doc_id", "digest").join(classes, "digest").select("doc_id", "first")
    if found is not None:
        label = components(found, stages)
        member = member.join(label.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("first"))
    return sizes.join(member, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
