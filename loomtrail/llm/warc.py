"""WARC records of pages, and a fixity audit of two replicas by Merkle trees.

A record's place is its page_id: files hold ``PER_FILE`` places each, in order. Leaves are read back from the files that
were written: file, offset and length of each record, and the sha256 of its bytes. A node stands for an ordered range of
offsets: its digest is the sha256 of its up to ``FAN`` children, each with its number, the file and offset where it
begins, the file and offset where it ends, and its digest, up to one root. So a record that moved is found as well as
one that changed. An audit compares the roots and then only the children of nodes that differ, level by level, down to
the records.

Null urls and bodies are empty. Rows without a page_id are left out; of rows that share one the greatest (url, html)
is used. Other columns are ignored. An empty replica has no nodes, so every record of the other one is reported.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages

FILE_SHIFT = 10
PER_FILE = 1 << FILE_SHIFT
SHIFT = 4
FAN = 1 << SHIFT
ENDING = "\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """place, file and the text of each record, without the empty lines that end it."""
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("place"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((url_col, "u"), (body_col, "b"))))
    if rows.groupBy("place").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("place").agg(F.max(F.struct("u", "b")).alias("r")).select("place", "r.u", "r.b")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("place").cast("string"), F.lit(">\r\nWARC-Target-URI: "), "u",
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("b").cast("string"), F.lit(ENDING),
    )
    return rows.select("place", F.shiftright("place", FILE_SHIFT).alias("file"), F.concat(head, "b").alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """place, file, offset, length and digest of each record; texts are not shuffled."""
    own = recs.select("place", "file", (F.octet_length("record") + len(ENDING)).cast("long").alias("length"), F.sha2(F.concat("record", F.lit(ENDING)), 256).alias("digest"))
    before = F.sum("length").over(Window.partitionBy("file").orderBy("place")) - F.col("length")  # PER_FILE rows at most
    return own.select("place", "file", before.alias("offset"), "length", "digest")


def write_warc(recs: DataFrame, path: str, compression: str = "none") -> None:
    """Real WARC files, one folder per file number, through Spark's text writer."""
    rows = recs.repartition("file").sortWithinPartitions("file", "place").select("file", F.col("record").alias("value"))
    rows.write.option("lineSep", ENDING).option("compression", compression).partitionBy("file").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """uri, place, file, offset, length, digest of each record of .warc or .warc.gz files of at most 2 GB each.

    Bytes behind a header that cannot be read become one record without a place.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(data) if name.endswith(".gz") else data
                out, at = [], 0
                while at < len(data):
                    cut = data.find(b"\r\n\r\n", at)
                    fields = dict(x.split(b": ", 1) for x in data[at:cut].split(b"\r\n")[1:] if b": " in x) if cut >= 0 else {}
                    size = fields.get(b"Content-Length", b"")
                    end = cut + 8 + int(size) if size.isdigit() and data[at : at + 5] == b"WARC/" else len(data)
                    place = fields.get(b"WARC-Record-ID", b"").strip(b"<>").rpartition(b":")[2]
                    out.append((fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), int(place) if place.isdigit() else None, name, at, min(end, len(data)) - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
                yield pd.DataFrame(out, columns=["uri", "place", "file", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(each, "uri string, place long, file string, offset long, length long, digest string")


def written_leaves(recs: DataFrame, stages: Stages, name: str) -> DataFrame:
    """Writes a replica and reads its leaves back: place, file, offset, length and digest."""
    path = f"{stages.root}/{name}"
    write_warc(recs, path, "gzip")
    schema = "place long, file long, offset long, length long, digest string"
    read = recs.sparkSession.createDataFrame([], schema) if recs.isEmpty() else read_warc(recs.sparkSession, path).withColumn("file", F.regexp_extract("file", "/file=(-?[0-9]+)/", 1).cast("long")).select("place", "file", "offset", "length", "digest")
    out = stages.write(read, f"{name}-leaves")
    stages.drop(name)
    return out


RANGE = ["file", "offset", "last_file", "last_end"]


def tree(leaf: DataFrame, stages: Stages, name: str, levels: int) -> list[DataFrame]:
    """(node, the range of offsets, digest) of each level above the leaves; each node gathers at most ``FAN`` children."""
    out, below = [], leaf.select(F.col("place").alias("node"), "file", "offset", F.col("file").alias("last_file"), (F.col("offset") + F.col("length")).alias("last_end"), "digest")
    for k in range(1, levels + 1):
        kids = F.sort_array(F.collect_list(F.struct("node", *RANGE, "digest")))
        text = F.array_join(F.transform(kids, lambda c: F.concat_ws(":", *(c[x].cast("string") for x in ("node", *RANGE, "digest")))), "\n")
        level = below.groupBy(F.shiftright("node", SHIFT).alias("up")).agg(F.sha2(text, 256).alias("digest"), F.min_by(F.struct("file", "offset"), "node").alias("b"), F.max_by(F.struct("last_file", "last_end"), "node").alias("e"))
        below = stages.write(level.select(F.col("up").alias("node"), "b.file", "b.offset", "e.last_file", "e.last_end", "digest"), f"{name}-{k}")
        out.append(below)
    return out


def audit(expected: DataFrame, actual: DataFrame, stages: Stages) -> DataFrame:
    """Places whose records differ: fault, offset and length as expected, and both digests. Takes two tables of leaves."""
    top = [r or 0 for side in (expected, actual) for r in side.agg(F.max("place"), -F.min("place")).first()]
    levels = 1
    while max(top) >> (SHIFT * levels):
        levels += 1
    trees = [tree(side, stages, name, levels) for side, name in ((expected, "expected"), (actual, "actual"))]
    suspect = None
    for k in range(levels, 0, -1):
        a, b = (t[k - 1] if suspect is None else t[k - 1].withColumn("up", F.shiftright("node", SHIFT)).join(suspect, "up", "left_semi") for t in trees)
        differ = a.selectExpr("node", "digest as x", "(file, offset, last_file, last_end) as r").join(b.selectExpr("node", "digest as y", "(file, offset, last_file, last_end) as s"), "node", "full").where("not (x <=> y and r <=> s)")
        suspect = stages.write(differ.select(F.col("node").alias("up")), f"differ-{k}")
    a, b = (side.withColumn("up", F.shiftright("place", SHIFT)).join(suspect, "up", "left_semi").drop("up") for side in (expected, actual))
    both = a.alias("a").join(b.selectExpr("place", "file as f", "offset as o", "length as n", "digest as actual_sha256"), "place", "full")
    both = both.where("not (digest <=> actual_sha256 and file <=> f and offset <=> o and length <=> n)")
    fault = F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.col("length") != F.col("n"), "length").when(F.col("digest") != F.col("actual_sha256"), "bytes").otherwise("moved")
    return both.select("place", F.coalesce("file", "f").alias("file"), F.coalesce("offset", "o").alias("offset"), F.coalesce("length", "n").alias("length"), F.col("o").alias("actual_offset"), fault.alias("fault"), F.col("digest").alias("expected_sha256"), "actual_sha256")


def spoiled(pages: DataFrame) -> DataFrame:
    """A replica with known faults: some bodies changed in one byte, some cut short, some records gone."""
    body = F.when(F.col("page_id") % 97 == 5, F.overlay("html", F.lit("~"), F.lit(1))).when(F.col("page_id") % 101 == 7, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    return pages.where("page_id % 103 <> 9").withColumn("html", body)


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    stages = Stages(spark, "op7")
    good, bad = (written_leaves(records(p), stages, name) for p, name in ((pages, "replica-expected"), (spoiled(pages), "replica-actual")))
    return audit(good, bad, stages).withColumnRenamed("place", "page_id")


def oracle() -> str:
    def record(body: str) -> str:
        return rf"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({body})
  || chr(13) || chr(10) || chr(13) || chr(10) || {body} || chr(13) || chr(10) || chr(13) || chr(10)"""

    changed = "CASE WHEN page_id % 97 = 5 THEN '~' || substr(h, 2) WHEN page_id % 101 = 7 THEN left(h, length(h) - 1) ELSE h END"
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, page_id // {PER_FILE} AS file, {record('h')} AS good, CASE WHEN page_id % 103 <> 9 THEN {record('(' + changed + ')')} END AS bad FROM p),
s AS (SELECT *, strlen(good) AS length, sum(strlen(good)) OVER w - strlen(good) AS "offset", sum(strlen(bad)) OVER w - strlen(bad) AS bad_offset FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, file::BIGINT AS file, "offset"::BIGINT AS "offset", length::BIGINT AS length, bad_offset::BIGINT AS actual_offset,
  CASE WHEN bad IS NULL THEN 'missing' WHEN strlen(bad) <> length THEN 'length' WHEN bad <> good THEN 'bytes' ELSE 'moved' END AS fault,
  sha256(good) AS expected_sha256, sha256(bad) AS actual_sha256
FROM s WHERE bad IS NULL OR bad <> good OR bad_offset <> s."offset"
"""
