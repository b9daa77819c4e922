"""Deterministic choices: stratified top-k, hash splits, source-disjoint splits, prefix lookup, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.graphs import prepare_checkpoints


def rank_hash(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def stratified_top(rows: DataFrame, bucket: str, order: list[Column], quotas: DataFrame, gate: Column) -> DataFrame:
    """Rows that pass the gate, best first, up to the quota of their bucket; ``quotas`` has bucket and quota."""
    most = quotas.agg(F.max("quota")).first()[0] or 0  # each task keeps as many of a bucket before the shuffle
    ranked = rows.where(gate).withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("place") <= most)
    return ranked.join(quotas, bucket).where("place <= quota")


def hash_split(rows: DataFrame, key: str, seed: int, n_test: int) -> DataFrame:
    """The n_test rows of least hash are the test split: a bounded top-n, so no window over all rows."""
    test = rows.select(key, rank_hash(seed, key).alias("_h")).orderBy("_h", key).limit(n_test).select(key, F.lit("test").alias("split"))
    return rows.join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def disjoint_split(links: DataFrame, item: str, source: str, seed: int, n_test: int) -> DataFrame:
    """Items that lie inside the held-out sources, items that overlap them, and the rest.

    Sources are held out in the order of their hashes until n_test items lie inside: an item's rank is the greatest
    hash of its sources, so the n_test least ranks give the bound, and no set is grown step by step.
    """
    ranked = links.withColumn("_h", rank_hash(seed, source))
    ends = ranked.groupBy(item).agg(F.max("_h").alias("_max"), F.min("_h").alias("_min"))
    bound = ends.orderBy("_max", item).limit(n_test).agg(F.max("_max").alias("_bound"))
    split = F.when(F.col("_max") <= F.col("_bound"), "test").when(F.col("_min") <= F.col("_bound"), "dropped").otherwise("train")
    return ends.crossJoin(bound).select(item, split.alias("split"))  # one row on the right


def prefix_lookup(items: DataFrame, item: str, table: DataFrame, prefix: str, value: str) -> DataFrame:
    """The value of the longest prefix of each item: all prefixes of an item are looked up by an equi-join."""
    cut = items.select(item, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(item), F.lit(1))), lambda n: F.substring(F.col(item), F.lit(1), n))).alias(prefix))
    hit = cut.join(table, prefix).groupBy(item).agg(F.max_by(F.struct(prefix, value), F.length(prefix)).alias("_b"))
    return items.join(hit, item, "left").select(item, F.col(f"_b.{prefix}").alias(prefix), F.col(f"_b.{value}").alias(value))


def shards(rows: DataFrame, order: list[str], by: str, n: int) -> DataFrame:
    """Shard of each row: its place among the rows of its group, modulo n.

    Rows are cut into ranges of group and order, numbered within a range, and moved on by the rows of the group in the
    ranges before; so a group of any size is spread over tasks. The ranges are written once, as they come from a sample.
    """
    prepare_checkpoints(rows.sparkSession)
    cut = rows.repartitionByRange(F.col(by), *(F.col(c) for c in order)).withColumn("_range", F.spark_partition_id()).checkpoint()
    held = cut.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1)
    same = placed[by].eqNullSafe(before[by]) & (placed["_range"] == before["_range"])
    out = placed.join(F.broadcast(before), same)  # a row per range, and one more per group
    return out.select(*(placed[c] for c in rows.columns), ((F.col("_place") + F.col("_before")) % n).alias("shard"))


def negatives(rows: DataFrame, by: str, before: Column, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each run before its root, by hash."""
    return rows.where(before).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(rank_hash(seed, key), key))).where(F.col("_r") <= n).drop("_r")
