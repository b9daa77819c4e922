"""Queries that check tasks made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import checks
from loomtrail.plans.tables import spread, table

OPERATIONS = ["R", "A", "N"]
#: Lines that a task takes of those that are dealt by order.
LINES = 1 << 17
#: The tables of the data, by application, with their key and the columns that are referred to.
KEYS = {"part": "p_partkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
COLUMNS = {"part": ["p_name", "p_size"], "supplier": ["s_name"], "orders": ["o_orderstatus", "o_custkey"]}
_REF = {
    "kind": "CASE WHEN l_linenumber % 2 = 0 THEN 'writes' ELSE 'reads' END",
    "t": "CASE WHEN l_partkey % 17 = 3 THEN 'shop.parts' WHEN l_linenumber = 3 THEN 'shop.supplier' ELSE 'shop.part' END",
    "c": "CASE WHEN l_suppkey % 13 = 5 THEN 'p_colour' WHEN l_linenumber = 5 THEN '*' WHEN l_linenumber = 3 THEN 's_name' ELSE 'p_size' END",
    "e": "CASE WHEN l_linenumber = 6 THEN concat('derived:', l_suppkey % 9, ':x') WHEN l_linenumber = 7 THEN 'part:any' WHEN l_linenumber = 2 AND l_partkey % 5 = 0 THEN 'part:*' WHEN l_linenumber = 3 THEN concat('supplier:', l_suppkey + CASE WHEN l_partkey % 4 = 0 THEN 1000000 ELSE 0 END) ELSE concat('part:00', l_partkey) END",
    "v": "l_partkey % 3 <> 0",
}


def _grounding(spark, d):
    line = table(spark, d, "lineitem")
    key = line.selectExpr("l_orderkey AS task", "CAST(l_linenumber AS STRING) AS node", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    nodes = key.groupBy("task", "node").agg(F.min(F.when(F.col("l_suppkey") % 11 == 4, "mail").otherwise("shop")).alias("app"))
    refs = key.selectExpr("task", "node", f"{_REF['kind']} AS kind", f"{_REF['t']} AS table", f"{_REF['c']} AS column", f"{_REF['e']} AS entity", f"{_REF['v']} AS has_value")
    ports = key.selectExpr("task", "node", "concat('p', l_linenumber) AS port", "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag WHEN l_partkey % 7 = 0 THEN '' END AS literal", "CASE WHEN l_suppkey % 19 = 2 THEN 'unbound:x' ELSE 'literal' END AS grounding")
    sql = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey AS task", "'1' AS node", "CASE WHEN o_custkey % 8 = 1 THEN 'mail' ELSE 'shop' END AS app", "'q' AS name", "CASE WHEN o_custkey % 6 = 2 THEN 'SELECT 1 FROM part JOIN goods ON 1 = 1' ELSE concat('SELECT ''FROM x'' FROM orders WHERE o_orderkey = ', o_orderkey) END AS sql")
    texts = table(spark, d, "orders").selectExpr("o_orderkey AS task", "concat('Buy ', o_orderstatus, ' now') AS text")
    columns = spark.createDataFrame([(f"shop.{t}", c) for t, cols in COLUMNS.items() for c in cols], "table string, column string")
    rows = None
    for t, k in KEYS.items():
        own = table(spark, d, t).select(F.lit(f"shop.{t}").alias("table"), F.col(k).alias("id"))
        rows = own if rows is None else rows.union(own)
    return nodes, refs, ports, sql, texts, columns, rows


def grounding_issues(spark, d):
    return checks.grounding_issues(*_grounding(spark, d))


def _structure(spark, d):
    """Orders as tasks: lines are nodes, each feeds the next one, and returned lines also feed one before."""
    line = table(spark, d, "lineitem")
    # lines are dealt by order once, a part of them small enough to be sorted in memory; what is made of them stays where it is
    tasks = max(4, 1 + line.count() // (LINES * spark.sparkContext.defaultParallelism))
    key = spread(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey", tasks).groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))
    made = lambda *rows: key.selectExpr("task", "explode(array(" + ", ".join(f"CASE WHEN {cond} THEN named_struct({cols}) END" for cond, cols in rows) + ")) AS r").where("r is not null").select("task", "r.*")
    nodes = made(("true", "'node', CAST(k AS STRING), 'op', CASE WHEN s % 23 = 7 THEN 'X' ELSE flag END, 'app', CASE WHEN s % 29 = 3 THEN ' ' ELSE 'shop' END"), ("p % 31 = 4", "'node', CAST(k AS STRING), 'op', flag, 'app', 'shop'"))
    ports = made(("true", "'node', CAST(k AS STRING), 'port', 'in', 'is_output', false, 'source', CASE WHEN k = 1 THEN 'world' WHEN p % 37 = 9 THEN 'file' ELSE 'upstream' END, 'grounding', CASE WHEN p % 3 = 0 THEN 'x' END"), ("true", "'node', CAST(k AS STRING), 'port', 'out', 'is_output', true, 'source', CAST(NULL AS STRING), 'grounding', CASE WHEN p % 41 <> 5 THEN 'y' END"))
    edges = made(
        ("k > 1 and s % 5 <> 0", "'edge', concat('e', k), 'from_node', CAST(k - 1 AS STRING), 'from_port', CASE WHEN p % 13 = 1 THEN 'in' ELSE 'out' END, 'to_node', CAST(k AS STRING), 'to_port', CASE WHEN p % 11 = 2 THEN 'other' ELSE 'in' END, 'kind', CASE WHEN p % 17 = 6 THEN 'loose' ELSE 'value_dependency' END"),
        ("k > 2 and flag = 'R' and p % 4 = 0", "'edge', CASE WHEN s % 7 = 0 THEN 'e2' ELSE concat('b', k) END, 'from_node', CAST(k AS STRING), 'from_port', 'out', 'to_node', CAST(k - 1 - s % 2 AS STRING), 'to_port', 'in', 'kind', 'control_dependency'"),
    )
    return nodes, ports, edges


def structure_issues(spark, d):
    return checks.structure_issues(*_structure(spark, d), OPERATIONS)


def task_validity(spark, d):
    return checks.verdicts(table(spark, d, "orders").select(F.col("o_orderkey").alias("task")), checks.grounding_issues(*_grounding(spark, d)))


QUERIES = {f.__name__: f for f in (grounding_issues, structure_issues, task_validity)}

_KNOWN = ", ".join(f"'shop.{t}'" for t in KEYS)
_CELLS = ", ".join(f"('shop.{t}', '{c}')" for t, cols in COLUMNS.items() for c in cols)
_GROUND = f"""l AS (SELECT l_orderkey AS task, l_linenumber::VARCHAR AS node, * FROM lineitem),
  r AS (SELECT task, node, {_REF['kind']} AS kind, {_REF['t']} AS t, {_REF['c']} AS c, {_REF['e']} AS e, {_REF['v']} AS v FROM l), k AS (SELECT * FROM r WHERE t IN ({_KNOWN})),
  x AS (SELECT *, regexp_extract(e, '^[^:]*:(.*)$', 1) AS id FROM k WHERE NOT starts_with(e, 'derived:')),
  d AS ({' UNION ALL '.join(f"SELECT 'shop.{t}' AS t, {key} AS id FROM {t}" for t, key in KEYS.items())}),
  o AS (SELECT *, CASE WHEN o_custkey % 8 = 1 THEN 'mail' ELSE 'shop' END AS app FROM orders),
  i AS (SELECT task, node, 'APP_WITHOUT_DATABASE' AS code, 'info' AS severity, 'mail' AS detail FROM (SELECT task, node, min(CASE WHEN l_suppkey % 11 = 4 THEN 'mail' ELSE 'shop' END) AS app FROM l GROUP BY 1, 2) WHERE app = 'mail'
    UNION SELECT task, node, 'TABLE_UNKNOWN', 'error', kind || ' ' || t FROM r WHERE t NOT IN ({_KNOWN})
    UNION SELECT task, node, 'COLUMN_UNKNOWN', 'error', kind || ' ' || t || ' ' || c FROM k WHERE c NOT IN ('rowid', '*') AND (t, c) NOT IN (VALUES {_CELLS})
    UNION SELECT task, node, 'DERIVED_REF_UNKNOWN', 'error', e FROM k WHERE starts_with(e, 'derived:') AND NOT EXISTS (SELECT 1 FROM l WHERE l.task = k.task AND l.node = split_part(e, ':', 2))
    UNION SELECT task, node, 'ENTITY_REF_NOT_ROWID', 'error', e FROM x WHERE id <> '*' AND NOT regexp_full_match(id, '[0-9]+')
    UNION SELECT task, node, 'ENTITY_MISSING', 'error', t || ' ' || try_cast(id AS BIGINT) FROM x WHERE regexp_full_match(id, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM d WHERE d.t = x.t AND d.id = try_cast(x.id AS BIGINT))
    UNION SELECT task, node, 'WRITE_VALUE_MISSING', 'error', t || ' ' || c FROM k WHERE kind = 'writes' AND NOT v
    UNION SELECT task, node, 'UNBOUND_INPUT', 'error', 'p' || node || ' unbound:x' FROM l WHERE l_suppkey % 19 = 2
    UNION SELECT task, node, 'LITERAL_NOT_IN_INSTRUCTION', 'error', 'p' || node || ' ' || l_returnflag FROM l JOIN orders ON o_orderkey = task WHERE l_suppkey % 19 <> 2 AND l_partkey % 2 = 0 AND NOT contains(lower('Buy ' || o_orderstatus || ' now'), lower(l_returnflag))
    UNION SELECT o_orderkey, '1', 'SQL_UNCHECKED', 'warning', 'q mail' FROM o WHERE app = 'mail'
    UNION SELECT o_orderkey, '1', 'SQL_COMPILE_ERROR', 'error', 'q no such table goods' FROM o WHERE app = 'shop' AND o_custkey % 6 = 2)"""
ORACLE = {
    "grounding_issues": f"WITH {_GROUND} SELECT * FROM i",
    "task_validity": f"WITH {_GROUND} SELECT o_orderkey AS task, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error') = 0 AS valid FROM orders LEFT JOIN i ON task = o_orderkey GROUP BY 1",
    "structure_issues": """WITH RECURSIVE l AS (SELECT l_orderkey AS task, l_linenumber AS k, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
      e AS (SELECT task, 'e' || k AS edge, k - 1 AS a, CASE WHEN p % 13 = 1 THEN 'in' ELSE 'out' END AS ap, k AS b, CASE WHEN p % 11 = 2 THEN 'other' ELSE 'in' END AS bp, p % 17 = 6 AS loose FROM l WHERE k > 1 AND s % 5 <> 0
        UNION ALL SELECT task, CASE WHEN s % 7 = 0 THEN 'e2' ELSE 'b' || k END, k, 'out', k - 1 - s % 2, 'in', false FROM l WHERE k > 2 AND flag = 'R' AND p % 4 = 0),
      r(task, a, b) AS (SELECT task, a, b FROM e UNION SELECT r.task, r.a, e.b FROM r JOIN e ON e.task = r.task AND e.a = r.b),
      i AS (SELECT task, k, 'INVALID_GROUNDING' AS code, 'duplicate node ' || k AS detail FROM l WHERE p % 31 = 4
        UNION SELECT task, k, 'INVALID_GROUNDING', 'unknown operation X' FROM l WHERE s % 23 = 7 UNION SELECT task, k, 'INVALID_GROUNDING', 'no app' FROM l WHERE s % 29 = 3
        UNION SELECT task, min(b), 'INVALID_GROUNDING', 'duplicate edge ' || edge FROM e GROUP BY task, edge HAVING count(*) > 1 UNION SELECT task, b, 'INVALID_GROUNDING', 'unknown dependency kind ' || edge FROM e WHERE loose
        UNION SELECT task, a, 'UNBOUND_PORT', 'source is no output ' || edge FROM e WHERE ap = 'in' OR NOT EXISTS (SELECT 1 FROM l WHERE l.task = e.task AND l.k = e.a) UNION SELECT task, b, 'UNBOUND_PORT', 'target is no input ' || edge FROM e WHERE bp = 'other' OR NOT EXISTS (SELECT 1 FROM l WHERE l.task = e.task AND l.k = e.b)
        UNION SELECT task, b, 'UNBOUND_PORT', 'several producers ' || bp FROM e GROUP BY task, b, bp HAVING count(*) > 1
        UNION SELECT task, k, 'UNBOUND_PORT', 'lacks an edge in' FROM l WHERE k > 1 AND p % 37 <> 9 AND NOT EXISTS (SELECT 1 FROM e WHERE e.task = l.task AND e.b = k AND bp = 'in')
        UNION SELECT task, k, 'INVALID_GROUNDING', 'lacks stable grounding in' FROM l WHERE k = 1 AND p % 3 <> 0 UNION SELECT task, k, 'INVALID_GROUNDING', 'invalid source in' FROM l WHERE k > 1 AND p % 37 = 9
        UNION SELECT task, k, 'INVALID_GROUNDING', 'lacks grounding out' FROM l WHERE p % 41 = 5
        UNION SELECT x.task, x.a, 'GLOBAL_CONSTRAINT_UNSAT', 'on a cycle with ' || min(y.a) FROM r x JOIN r y ON y.task = x.task AND y.a = x.b AND y.b = x.a GROUP BY x.task, x.a)
      SELECT task, k::VARCHAR AS node, code, 'error' AS severity, detail FROM i""",
}
