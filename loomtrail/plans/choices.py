"""Queries over samples, splits and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import sampling
from loomtrail.plans.runs import root_cause_pick
from loomtrail.plans.tables import EV, indexed_events, table

SEED = 20260902


def stratified_topk(spark, d):
    p = table(spark, d, "part")
    quotas = p.select("p_brand").distinct().withColumn("quota", F.lit(2) + F.substring("p_brand", -1, 1).cast("int") % 3)
    out = sampling.stratified_top(p, "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], quotas, F.col("p_size") > 5)
    return out.select("p_partkey", "p_brand", F.col("place").cast("long").alias("place"))


def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", SEED, 100)


def source_disjoint_split(spark, d):
    return sampling.disjoint_split(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", SEED, 50)


def prefix_lookup(spark, d):
    n = table(spark, d, "nation")
    prefixes = n.groupBy(F.expr("left(n_name, 1 + n_nationkey % 3)").alias("prefix")).agg(F.min("n_nationkey").alias("value"))
    return sampling.prefix_lookup(n.select("n_name"), "n_name", prefixes, "prefix", "value")


def shard_assignment(spark, d):
    return sampling.shards(table(spark, d, "orders"), ["o_orderkey"], "o_orderpriority", 8).select("o_orderkey", F.col("shard").cast("long").alias("shard"))


def negative_samples(spark, d):
    """Steps before the root of their run, or of the whole run where it has none."""
    e = indexed_events(spark, d).join(root_cause_pick(spark, d).select("user_id", F.col("idx").alias("root")), "user_id", "left")
    return sampling.negatives(e, "user_id", F.coalesce(F.col("idx") < F.col("root"), F.lit(True)), 3, SEED, "event_id").select("user_id", "event_id")


def multiset_recall(spark, d):
    """How many of a user's operations, as a multiset, the next user's run holds too."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    other = n.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("n").alias("m"))
    return n.join(other, ["user_id", "event_type"], "left").groupBy("user_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("shared"), F.sum("n").alias("total"))


def symmetric_difference(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    a, b = (l.where(f"l_orderkey % 2 = {k}").select("l_partkey", "l_suppkey", "l_quantity") for k in (0, 1))
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def dedup_key(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def resume_append(spark, d):
    """Orders that a sink, here every third one, does not hold yet."""
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(o.where("o_orderkey % 3 = 0"), "o_orderkey", "left_anti")


def consensus(spark, d):
    """Orders whose lines all name the same flag, and the flag: reviewers that agree."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"), F.count("*").alias("n"))
    return l.where(F.size("s") == 1).select("l_orderkey", F.col("s")[0].alias("flag"), "n")


QUERIES = {f.__name__: f for f in (stratified_topk, hash_split, source_disjoint_split, prefix_lookup, shard_assignment, negative_samples, multiset_recall, symmetric_difference, dedup_key, resume_append, consensus)}

ORACLE = {
    "stratified_topk": "SELECT p_partkey, p_brand, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size > 5) WHERE k <= 2 + right(p_brand, 1)::INT % 3",
    "hash_split": f"SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY sha256('{SEED}|' || c_custkey), c_custkey) <= 100 THEN 'test' ELSE 'train' END AS split FROM customer",
    "source_disjoint_split": f"""WITH e AS (SELECT l_orderkey, max(sha256('{SEED}|' || l_suppkey)) AS hi, min(sha256('{SEED}|' || l_suppkey)) AS lo FROM lineitem GROUP BY 1),
      b AS (SELECT max(hi) AS m FROM (SELECT hi FROM e ORDER BY hi, l_orderkey LIMIT 50)) SELECT l_orderkey, CASE WHEN hi <= m THEN 'test' WHEN lo <= m THEN 'dropped' ELSE 'train' END AS split FROM e, b""",
    "prefix_lookup": """WITH t AS (SELECT left(n_name, 1 + n_nationkey % 3) AS prefix, min(n_nationkey) AS value FROM nation GROUP BY 1)
      SELECT n_name, arg_max(prefix, length(prefix)) AS prefix, arg_max(value, length(prefix)) AS value FROM nation LEFT JOIN t ON starts_with(n_name, prefix) GROUP BY 1""",
    "shard_assignment": "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 8 AS shard FROM orders",
    "negative_samples": f"WITH {EV}, r AS (SELECT user_id, idx AS root FROM ev WHERE value > 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx // 5, event_type <> 'error', value DESC, event_id) = 1) SELECT user_id, event_id FROM ev LEFT JOIN r USING (user_id) WHERE root IS NULL OR idx < root QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('{SEED}|' || event_id), event_id) <= 3",
    "multiset_recall": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT a.user_id, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS shared, sum(a.n)::BIGINT AS total FROM n a LEFT JOIN n b ON b.user_id = a.user_id + 1 AND b.event_type = a.event_type GROUP BY 1""",
    "symmetric_difference": """WITH a AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 1)
      SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "dedup_key": "SELECT sha256(concat_ws('|', lang, text)) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "resume_append": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0",
    "consensus": "SELECT l_orderkey, min(l_returnflag) AS flag, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
}
