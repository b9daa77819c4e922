"""Change logs: replay to a state, net change, snapshot differences, changed flags, duplicates, late rows, digests.

A log has a sequence number, a key, an operation (INSERT, UPDATE, DELETE) and row images. Every operator groups by
key, so it needs one shuffle on the key and no ordering of the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(baseline: DataFrame, log: DataFrame, key: str, seq: str, op: str, image: list[str], until: int | None = None) -> DataFrame:
    """The state after the log up to ``until``: the last image of each changed key, and what was not touched.

    Images are whole rows, so only the last change counts; a key whose last change is DELETE is gone.
    """
    log = log if until is None else log.where(F.col(seq) <= until)
    last = log.groupBy(key).agg(F.max_by(F.struct(op, *image), seq).alias("_last"))
    kept = baseline.select(key, *image).join(last.select(key), key, "left_anti")
    new = last.where(F.col(f"_last.{op}") != "DELETE").select(key, *(F.col(f"_last.{c}") for c in image))
    return kept.unionByName(new)


def net_change(log: DataFrame, key: str, seq: str, before: str, after: str) -> DataFrame:
    """Keys whose last image differs from their first one."""
    ends = log.groupBy(key).agg(F.min_by(before, seq).alias("first"), F.max_by(after, seq).alias("last"))
    return ends.where(~F.col("first").eqNullSafe(F.col("last")))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of either snapshot that differ: INSERT, DELETE or UPDATE, with both images as JSON."""
    old, new = (df.select(*key, F.to_json(F.struct(*columns)).alias(name)) for df, name in ((before, "old_json"), (after, "new_json")))
    op = F.when(F.col("old_json").isNull(), "INSERT").when(F.col("new_json").isNull(), "DELETE").otherwise("UPDATE")
    return old.join(new, key, "full").where(~F.col("old_json").eqNullSafe(F.col("new_json"))).withColumn("op", op)


def changed_flag(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """Whether a row's value differs from the one before it; the first row has changed."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("changed", ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))


def repeated_writes(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Second and later rows of a key, with their number."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("nth > 1")


def split_late(rows: DataFrame, index: Column, current: Column) -> DataFrame:
    """Marks rows that were stamped for another action than the current one; they are left out of a step's changes."""
    return rows.withColumn("late", ~index.eqNullSafe(current))


def row_digest(df: DataFrame, columns: list[str], name: str = "digest") -> DataFrame:
    """sha256 of each row's values as text; null and empty differ."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    return df.withColumn(name, F.sha2(text, 256))


def table_digest(df: DataFrame, columns: list[str], levels: int | None = None, leaf: int = 1 << 17) -> DataFrame:
    """One digest of a table that does not depend on row order or partitions.

    Rows are hashed; a group of rows, by the bytes of their digest behind the first, hashes its sorted digests, 256 groups
    form the next level, and so on up to one. There are as many levels as leave about ``leaf`` rows to a group, so no
    task sorts more at any size of the table; digests are comparable at equal levels.
    """
    if levels is None:
        n, levels = df.count(), 1
        while n > leaf << (8 * levels):
            levels += 1
    rows = row_digest(df.select(*columns), columns, "_d")
    key = F.conv(F.substring("_d", 3, 2 * levels), 16, 10).cast("long")
    part = rows.groupBy(key.alias("_b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), "\n"), 256).alias("_p"))
    for _ in range(levels):
        own = F.transform(F.sort_array(F.collect_list(F.struct("_b", "_p"))), lambda x: x["_p"])
        part = part.groupBy(F.floor(F.col("_b") / 256).alias("_up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(own, "\n"), 256).alias("_p")).withColumnRenamed("_up", "_b")
    none = F.sha2(F.lit(""), 256)
    return part.agg(F.sum("n").alias("n_rows"), F.coalesce(F.max("_p"), none).alias("digest"))


def compare_components(expected: DataFrame, observed: DataFrame, key: str, value: str, ignored: list[str]) -> DataFrame:
    """Components of two fingerprints that differ or are on one side only."""
    both = expected.select(key, F.col(value).alias("expected")).join(observed.select(key, F.col(value).alias("observed")), key, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")) & ~F.col(key).isin(ignored))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``target`` with each row of ``rows``, one per key, in the place of the one with its key, or added."""
    return target.join(rows.select(*key), key, "left_anti").select(*key, *columns).unionByName(rows.select(*key, *columns))
