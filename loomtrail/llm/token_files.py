"""Token ids in Parquet: a list column in id order, with bounded row groups and pages, and starts of all documents.

Files hold rows in ascending doc_id order: ids (list of int32, dictionary-encoded), n_tokens, and ``before``, the ids
of the earlier rows of the same file. A manifest holds one row per file with the ids of all earlier files, so the
start of a document in the whole corpus takes no second pass over the ids. Row-group and page statistics of doc_id
let readers fetch some documents only, and metadata columns are read without the ids.

Texts are encoded whole, as the tokenizers library does: the contents of its special tokens become those tokens. Null and
empty texts hold only the end id. Rows without a doc_id come first; rows that share a doc_id are ordered by
a hash of their texts, and equal rows are all kept. Columns other than doc_id and text are ignored. An empty table
gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages
from loomtrail.llm.pretokens import Ids, chunks, gpt_pieces, joined

SCHEMA = "part int, before long, doc_id long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page, before compression.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
END_ID = 2

_WORKER: dict[str, Ids] = {}


def byte_bpe(path: str) -> Ids:
    """The tokenizers library's encoder, asked once per pre-token of a worker; a line feed is a pre-token of its own."""
    if path not in _WORKER:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        (mark,) = library(["\n"])[0]
        _WORKER[path] = Ids(joined(library, "\n", mark, lambda x: x[-1].isspace()), gpt_pieces, marks, library)
    return _WORKER[path]


def with_end(ids: np.ndarray, size: np.ndarray, end_id: int) -> np.ndarray:
    """Appends ``end_id`` to each document's ids."""
    return np.insert(ids, np.cumsum(size), end_id)


def encode_partition(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    ids_of = byte_bpe(path)
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi, texts in chunks(batch.column("text")):
            ids, size = ids_of(texts)
            ids, size = with_end(ids, size, end_id), size + 1
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + ends - size), batch.column("doc_id")[lo:hi], pa.array(size),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["part", "before", "doc_id", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` and writes the files to ``path``/ids and the manifest to ``path``/manifest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    out = ordered.select("doc_id", "text").mapInArrow(lambda b: encode_partition(b, tokenizer, end_id), SCHEMA)
    out.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": 2000}).parquet(f"{path}/ids")
    spark = docs.sparkSession
    sums = spark.read.schema(SCHEMA).parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file goes to one task: it numbers the files, whatever they hold
    sums.selectExpr("part", "sum(n) over (order by part) - n as first").write.parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, n_tokens and the ``columns`` asked for; without "ids" no id is read.

    The manifest, of 12 bytes per file, is broadcast: 10 MB for a million files.
    """
    files = spark.read.schema(SCHEMA).parquet(f"{path}/ids").select("part", "before", "doc_id", "n_tokens", *columns)
    manifest = spark.read.schema("part int, first long").parquet(f"{path}/manifest")
    return files.join(F.broadcast(manifest), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", *columns)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with ids from ``first`` to ``last``; the bounds reach the scan, which skips row groups and pages."""
    out = read_metadata(spark, path, ("ids",))
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    return out if last is None else out.where(F.col("doc_id") <= last)


def list_crc32(column: pa.Array) -> pa.Array:
    """The unsigned crc32 of each list's values as little-endian 32-bit integers; null is empty."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    data = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())


def checksums(tokens: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ids_crc32."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), list_crc32(b.column("ids"))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "op1")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), stages.root, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(read_tokens(spark, stages.root))
