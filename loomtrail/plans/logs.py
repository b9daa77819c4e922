"""Queries over change logs and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrail.operators import changes
from loomtrail.plans.tables import EV, indexed_events, table


def replay_until(spark, d):
    e = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value"))
    return changes.replay(base, e, "user_id", "event_id", "op", ["event_type", "value"], until=e.agg(F.expr("max(event_id) * 3 div 5")).first()[0])


def net_change(spark, d):
    return changes.net_change(table(spark, d, "events"), "user_id", "event_id", "event_type", "event_type")


def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    after = o.where("o_orderkey % 10 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changes.snapshot_diff(o.where("o_orderkey % 10 <> 3"), after, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


def state_changed_flag(spark, d):
    return changes.changed_flag(table(spark, d, "conversations"), "conv_id", "turn", F.sha2("role", 256)).select("conv_id", "turn", "changed")


def duplicate_write(spark, d):
    return changes.repeated_writes(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type", F.col("nth").cast("long").alias("nth"))


def late_rows(spark, d):
    e = indexed_events(spark, d)
    return changes.split_late(e, F.col("idx"), F.col("idx") + (F.col("event_id") % 17 == 0).cast("int")).groupBy("user_id").agg(F.count_if("late").alias("n_late"), F.count_if(~F.col("late")).alias("n_kept"))


def row_digest(spark, d):
    return changes.row_digest(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"]).select("c_custkey", "digest")


def table_digest(spark, d):
    return changes.table_digest(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def component_diff(spark, d):
    n = table(spark, d, "nation")
    expected = n.where("n_nationkey % 9 <> 4").select("n_name", F.sha2(F.col("n_regionkey").cast("string"), 256).alias("sha"))
    observed = n.where("n_nationkey % 8 <> 2").select("n_name", F.sha2((F.col("n_regionkey") + (F.col("n_nationkey") % 6 == 5).cast("int")).cast("string"), 256).alias("sha"))
    return changes.compare_components(expected, observed, "n_name", "sha", ["FRANCE"])


def event_gaps(spark, d):
    """Offsets per log: first and last sequence number and rows, and the largest gap between neighbours.

    Neighbours are found within stretches of the sequence, and then between the ends of these.
    """
    key = ["event_type", "stretch"]
    e = table(spark, d, "events").withColumn("stretch", F.floor(F.col("event_id") / 10_000))
    inner = e.withColumn("gap", F.col("event_id") - F.lag("event_id").over(Window.partitionBy(*key).orderBy("event_id")))
    part = inner.groupBy(*key).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n"), F.max("gap").alias("gap"))
    part = part.withColumn("before", F.col("lo") - F.lag("hi").over(Window.partitionBy("event_type").orderBy("stretch")))
    return part.groupBy("event_type").agg(F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), F.sum("n").alias("n"), F.max(F.greatest("gap", "before")).alias("largest_gap"))


QUERIES = {f.__name__: f for f in (replay_until, net_change, snapshot_diff, state_changed_flag, duplicate_write, late_rows, row_digest, table_digest, component_diff, event_gaps)}

ORACLE = {
    "replay_until": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= (SELECT max(event_id) * 3 // 5 FROM events))
      SELECT c_custkey AS user_id, 'none' AS event_type, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)
      UNION ALL SELECT user_id, event_type, value FROM l WHERE k = 1 AND event_type <> 'error'""",
    "net_change": "SELECT * FROM (SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) WHERE first IS DISTINCT FROM last",
    "snapshot_diff": """WITH b AS (SELECT o_orderkey, to_json({'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS j FROM orders WHERE o_orderkey % 10 <> 3),
      a AS (SELECT o_orderkey, to_json({'o_custkey': o_custkey, 'o_orderstatus': CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END})::VARCHAR AS j FROM orders WHERE o_orderkey % 10 <> 7)
      SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.j AS old_json, a.j AS new_json, CASE WHEN b.j IS NULL THEN 'INSERT' WHEN a.j IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
      FROM b FULL JOIN a ON b.o_orderkey = a.o_orderkey WHERE b.j IS DISTINCT FROM a.j""",
    "state_changed_flag": "SELECT conv_id, turn, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "duplicate_write": "SELECT * FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) WHERE nth > 1",
    "late_rows": f"WITH {EV} SELECT user_id, count(*) FILTER (event_id % 17 = 0) AS n_late, count(*) FILTER (event_id % 17 <> 0) AS n_kept FROM ev GROUP BY 1",
    "row_digest": "SELECT c_custkey, sha256(concat_ws('|', coalesce('=' || c_custkey, '-'), coalesce('=' || c_name, '-'), coalesce('=' || c_nationkey, '-'))) AS digest FROM customer",
    "table_digest": """WITH r AS (SELECT sha256(concat_ws('|', coalesce('=' || n_nationkey, '-'), coalesce('=' || n_name, '-'), coalesce('=' || n_regionkey, '-'))) AS d FROM nation),
      h AS (SELECT d, (strpos('0123456789abcdef', substr(d, 3, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(d, 4, 1)) - 1 AS b FROM r),
      p AS (SELECT b, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS p FROM h GROUP BY 1)
      SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(p, chr(10) ORDER BY b)) AS digest FROM p""",
    "component_diff": """WITH e AS (SELECT n_name, sha256(n_regionkey::VARCHAR) AS s FROM nation WHERE n_nationkey % 9 <> 4),
      o AS (SELECT n_name, sha256((n_regionkey + (n_nationkey % 6 = 5)::INT)::VARCHAR) AS s FROM nation WHERE n_nationkey % 8 <> 2)
      SELECT coalesce(e.n_name, o.n_name) AS n_name, e.s AS expected, o.s AS observed FROM e FULL JOIN o ON e.n_name = o.n_name WHERE e.s IS DISTINCT FROM o.s AND coalesce(e.n_name, o.n_name) <> 'FRANCE'""",
    "event_gaps": """SELECT event_type, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n, max(gap) AS largest_gap
      FROM (SELECT *, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events) GROUP BY 1""",
}
