"""Queries over mutations of values that orders produce."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import mutations
from loomtrail.plans.tables import table

TYPES = ["supplier_ref", "ship_date", "total_price", "line_items", "is_open", "clerk_name", "other"]
#: Type, kind and value of a line's value, as SQL that Spark and DuckDB both read.
_TYPE = "CASE l_linenumber " + " ".join(f"WHEN {k + 1} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
_KIND = "CASE WHEN l_linenumber IN (1, 3) THEN 'number' WHEN l_linenumber = 4 THEN 'list' WHEN l_linenumber = 5 THEN 'boolean' ELSE 'text' END"
_VALUE = """CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS VARCHAR(20)) WHEN 2 THEN concat('2024-03-', l_partkey % 20 + 10, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'T10:30' END) WHEN 3 THEN CAST(l_partkey AS VARCHAR(20))
  WHEN 4 THEN CASE WHEN l_partkey % 3 = 0 THEN '["a"]' ELSE '["a","b","c"]' END WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END ELSE concat(l_returnflag, '-', l_partkey) END"""


def _produced(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag")))
    return line.selectExpr("l_orderkey AS task", "CAST(l_linenumber AS STRING) AS node", "l_linenumber AS place", "'v' AS name", f"{_TYPE} AS type", f"{_KIND} AS kind", f"{_VALUE} AS value", "l_linenumber", "l_partkey")


def mutation_records(spark, d):
    p = _produced(spark, d)
    two = p.select("task", "node", "place", "name", "type").union(p.selectExpr("task", "node", "place + 100", "'w'", "'name'"))
    return mutations.static_records(two, p.where("l_partkey % 5 = 0").select("task", "node"), p.select("task", "node", F.col("l_partkey").alias("horizon")))


def mutated_values(spark, d):
    suppliers = table(spark, d, "supplier").select(F.lit("supplier").alias("table"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("label"))
    m = mutations.mutations_of(_produced(spark, d)).withColumn("table", F.lit("supplier")).select("task", "node", "name", "mutation", "table", "kind", "value")
    return mutations.mutated_values(m, suppliers, 3).drop("table", "kind")


def mutation_outcomes(spark, d):
    """Lines are steps and mutations at once: a check of a later line fails by its part."""
    p = _produced(spark, d)
    ids = p.select(F.concat_ws("/", "task", "node").alias("id"), "task", "node", "place", "l_partkey")
    results = ids.join(ids.select("task", F.col("node").alias("other"), F.col("l_partkey").alias("x")), "task").select("id", F.col("other").alias("node"), ((F.col("l_partkey") + F.col("x")) % 4 != 0).alias("passed"))
    ends = ids.selectExpr("id", "CASE WHEN l_partkey % 17 = 4 THEN 'boom' END AS error", "CASE WHEN l_partkey % 3 <> 1 THEN l_partkey % 3 = 0 END AS final_passed", "CASE WHEN l_partkey % 10 = 0 THEN 'state' END AS diverged")
    return mutations.outcomes(ids.select("id", "task", "node"), ids.select("task", "node", "place"), results, ends)


QUERIES = {f.__name__: f for f in (mutation_records, mutated_values, mutation_outcomes)}

_LINES = "l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"
_BY = {1: "entity", 2: "date", 3: "amount", 4: "list", 5: "boolean", 6: "text", 7: "text"}
_OF = "(VALUES " + ", ".join(f"({k}, '{m}')" for k, f in _BY.items() for m in mutations.BY_FAMILY[f]) + ") f(k, mutation)"
ORACLE = {
    "mutation_records": f"""WITH {_LINES}, m AS (SELECT l.*, mutation, 0 AS o, 'v' AS name FROM l JOIN {_OF} ON k = l_linenumber UNION ALL SELECT l.*, unnest({mutations.BY_FAMILY['text']}), 1, 'w' FROM l UNION ALL SELECT l.*, unnest({mutations.WRITES}), 2, '<writes>' FROM l WHERE l_partkey % 5 = 0)
      SELECT l_orderkey AS task, l_linenumber::VARCHAR AS node, mutation, 'static:' || arg_min(name, o) || ':' || mutation AS mutated_ref, CASE WHEN min(o) < 2 THEN 'derived:' || l_linenumber || ':' || arg_min(name, o) END AS original_ref, min(l_partkey) AS horizon FROM m GROUP BY l_orderkey, l_linenumber, mutation""",
    "mutation_outcomes": f"""WITH {_LINES}, r AS (SELECT a.l_orderkey AS task, a.l_linenumber AS k, min(b.l_linenumber) AS f FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber AND (a.l_partkey + b.l_partkey) % 4 = 0 GROUP BY 1, 2),
      o AS (SELECT l.*, f, (SELECT count(*) FROM l c WHERE c.l_orderkey = l.l_orderkey AND c.l_linenumber > l.l_linenumber AND c.l_linenumber <= f)::INTEGER AS n FROM l LEFT JOIN r ON task = l_orderkey AND k = l_linenumber)
      SELECT l_orderkey || '/' || l_linenumber AS id, CASE WHEN l_partkey % 17 = 4 THEN 'execution_error' WHEN f IS NOT NULL THEN f::VARCHAR WHEN l_partkey % 3 = 2 THEN 'final' WHEN l_partkey % 10 = 0 THEN 'state' END AS caught_by, CASE WHEN l_partkey % 17 <> 4 AND f IS NOT NULL THEN n END AS distance,
        CASE WHEN l_partkey % 17 = 4 THEN 'verifier_only' WHEN f IS NOT NULL THEN CASE WHEN n = 1 THEN 'required_next' ELSE 'required_later' END WHEN l_partkey % 3 = 2 OR l_partkey % 10 = 0 THEN 'verifier_only' ELSE 'silent' END AS class FROM o""",
}
