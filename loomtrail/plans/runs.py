"""Queries over the ordered steps of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import steps
from loomtrail.plans.tables import EV, indexed_events, table

DEPTHS = [0, 1, 2, 3, 4, 5]


def carry_forward(spark, d):
    c = table(spark, d, "conversations")
    return steps.carry_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "before").select("conv_id", "turn", "before")


def within_turn_index(spark, d):
    return steps.within(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "place").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


def _cases(spark, d):
    c = table(spark, d, "conversations")
    runs = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("root"), F.max("turn").alias("last")).where("root is not null")
    runs = runs.withColumn("explicit", F.when(F.col("conv_id") % 7 > 0, F.col("root") + F.col("conv_id") % 7 - 1))
    return steps.depth_cases(runs, "root", "last", "explicit", DEPTHS)


def depth_grid_cases(spark, d):
    return _cases(spark, d).select("conv_id", F.col("depth").cast("long").alias("depth"), "cut", "reason")


def depth_prefixes(spark, d):
    out = steps.prefixes(table(spark, d, "conversations"), _cases(spark, d), "conv_id", "turn", "turn")
    return out.groupBy("conv_id", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n_steps"), F.max("place").cast("long").alias("last_place"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda x: x["role"]), ","), 256).alias("digest"))


def root_cause_pick(spark, d):
    e = indexed_events(spark, d).where("value > 40")
    order = [F.floor(F.col("idx") / 5).asc(), F.when(F.col("event_type") == "error", 0).otherwise(1).asc(), F.col("value").desc(), F.col("event_id").asc()]
    return steps.root_cause(e, "user_id", order).select("user_id", "event_id", "event_type", "idx")


def latest_run_wins(spark, d):
    return steps.pick(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


def ledger(spark, d):
    e = indexed_events(spark, d).withColumn("fact", F.floor(F.col("value") / 5).cast("long")).select("user_id", "idx", "fact", "event_type")
    later = e.alias("a").join(e.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.idx") > F.col("a.idx")) & (F.col("a.fact") == F.col("b.fact"))).select(F.col("a.user_id").alias("user_id"), F.col("a.idx").alias("idx"))
    return steps.ledger(e, "user_id", "idx", "fact", "event_type", e.where("event_type = 'signup'"), later)


def truncations(spark, d):
    """Cuts at offsets behind a run's first error that lie within the run."""
    r = indexed_events(spark, d).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("idx"))).alias("evidence"), F.max("idx").alias("last"))
    return r.where("evidence is not null").select("user_id", "last", F.explode(F.array(*(F.col("evidence") + k for k in (0, 1, 3, 8)))).alias("cut")).where("cut <= last")


def neutral_segments(spark, d):
    e = indexed_events(spark, d).select("user_id", "idx", F.floor(F.col("value") / 50).cast("long").alias("value"), F.col("event_type").alias("key"), F.lit("home").alias("page"))
    return steps.neutral_segments(e, "user_id", "idx", "key", "value", "page")


def token_matched(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.ceil(F.col("n_chars") / 4).alias("tokens"), F.lit(20_000).alias("target"))
    return steps.token_matched(docs, "lang", "tokens", "target", 0.05, F.sha2(F.col("doc_id").cast("string"), 256)).select("doc_id", "lang", "tokens")


QUERIES = {f.__name__: f for f in (carry_forward, within_turn_index, depth_grid_cases, depth_prefixes, root_cause_pick, latest_run_wins, ledger, truncations, neutral_segments, token_matched)}

_CASES = """c0 AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS root, max(turn) AS last FROM conversations GROUP BY 1 HAVING root IS NOT NULL),
  c AS (SELECT conv_id, root, last, CASE WHEN conv_id % 7 > 0 THEN root + conv_id % 7 - 1 END AS explicit, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS depth FROM c0),
  g AS (SELECT conv_id, depth, root + depth AS cut, CASE WHEN explicit IS NULL THEN 'no_explicit_error' WHEN root + depth > last THEN 'beyond_end' WHEN root + depth > explicit THEN 'beyond_explicit_error' ELSE 'eligible' END AS reason FROM c)"""

ORACLE = {
    "carry_forward": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations",
    "within_turn_index": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place FROM conversations",
    "depth_grid_cases": f"WITH {_CASES} SELECT conv_id, depth, cut, reason FROM g",
    "depth_prefixes": f"""WITH {_CASES}, p AS (SELECT g.conv_id, depth, role, turn FROM g JOIN conversations v ON v.conv_id = g.conv_id AND v.turn <= g.cut WHERE reason = 'eligible')
      SELECT conv_id, depth, count(*) AS n_steps, count(*) - 1 AS last_place, sha256(string_agg(role, ',' ORDER BY turn)) AS digest FROM p GROUP BY 1, 2""",
    "root_cause_pick": f"""WITH {EV} SELECT user_id, event_id, event_type, idx FROM ev WHERE value > 40
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx // 5, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, value DESC, event_id) = 1""",
    "latest_run_wins": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "ledger": f"""WITH {EV}, f AS (SELECT user_id, idx, floor(value / 5)::BIGINT AS fact, event_type FROM ev), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, fact ORDER BY idx) = 1)
      SELECT user_id, fact, idx, event_type FROM o WHERE EXISTS (SELECT 1 FROM f WHERE f.user_id = o.user_id AND f.fact = o.fact AND (f.event_type = 'signup' OR f.idx > o.idx))""",
    "truncations": f"""WITH {EV}, r AS (SELECT user_id, min(idx) FILTER (event_type = 'error') AS evidence, max(idx) AS last FROM ev GROUP BY 1)
      SELECT * FROM (SELECT user_id, last, evidence + unnest([0, 1, 3, 8]) AS cut FROM r WHERE evidence IS NOT NULL) WHERE cut <= last""",
}
