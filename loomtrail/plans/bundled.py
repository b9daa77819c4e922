"""Queries over the files of selections made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import bundles
from loomtrail.plans.tables import table


def file_closure(spark, d):
    """Orders are items, lines the rows of their trajectories, suppliers the folders that rows came from."""
    o = table(spark, d, "orders")
    items = o.selectExpr("concat('/t/', o_orderkey) AS trajectory", "concat('/r/', o_custkey, '.json') AS review", "CASE WHEN o_orderkey % 3 = 0 THEN concat('/f/', o_orderkey) END AS fixed")
    records = table(spark, d, "lineitem").selectExpr("concat(CASE WHEN l_linenumber > 4 THEN '/f/' ELSE '/t/' END, l_orderkey) AS path", "concat('/s/', l_suppkey, '/', l_returnflag, '.jsonl#line=', l_linenumber) AS source", "CASE WHEN l_partkey % 9 = 2 THEN 'Agent-X' END AS agent")
    files = o.where("o_orderkey % 7 <> 1").selectExpr("concat('/t/', o_orderkey) AS path").union(o.where("o_orderkey % 5 <> 2").selectExpr("concat('/f/', o_orderkey)"))
    s = table(spark, d, "supplier")
    files = files.union(s.where("s_suppkey % 4 <> 3").selectExpr("concat('/s/', s_suppkey, '/R.jsonl')")).union(s.where("s_suppkey % 3 = 0").selectExpr("concat('/s/', s_suppkey, '/probe.json')")).union(s.where("s_suppkey % 2 = 0").selectExpr("concat('/s/', s_suppkey, '/messages.json')"))
    return bundles.file_closure(items, ["trajectory", "review"], "trajectory", records, files, "probe.json", "messages.json", "agent-x", "fixed")


def canonical_copies(spark, d):
    """Customers are runs, and their orders the copies that are there."""
    o = table(spark, d, "orders")
    copies = o.selectExpr("o_custkey AS run", "concat('/c/', o_orderkey) AS path", "o_orderpriority AS sha256")
    selection = table(spark, d, "customer").selectExpr("c_custkey AS run", "concat('/c/', c_custkey * 5) AS path", "CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '9' END AS sha256")
    return bundles.canonical_copies(selection, copies)


QUERIES = {f.__name__: f for f in (file_closure, canonical_copies)}

ORACLE = {
    "file_closure": """WITH f AS (SELECT '/t/' || o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 1 UNION SELECT '/f/' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 2 UNION SELECT '/s/' || s_suppkey || '/R.jsonl' FROM supplier WHERE s_suppkey % 4 <> 3
        UNION SELECT '/s/' || s_suppkey || '/probe.json' FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT '/s/' || s_suppkey || '/messages.json' FROM supplier WHERE s_suppkey % 2 = 0),
      l AS (SELECT l_orderkey, '/s/' || l_suppkey AS dir, l_returnflag, l_partkey % 9 = 2 AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 1 AND (l_linenumber <= 4 OR o_orderkey % 3 = 0 AND o_orderkey % 5 <> 2)),
      n AS (SELECT '/t/' || o_orderkey AS path, 'trajectory' AS role FROM orders UNION SELECT '/r/' || o_custkey || '.json', 'review' FROM orders UNION SELECT '/f/' || o_orderkey, 'repaired' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 1
        UNION SELECT dir || '/' || l_returnflag || '.jsonl', 'source' FROM l UNION SELECT dir || '/probe.json', 'sidecar' FROM l WHERE dir || '/probe.json' IN (SELECT path FROM f) UNION SELECT dir || '/messages.json', 'messages' FROM l WHERE x)
      SELECT path, CASE WHEN path IN (SELECT path FROM f) OR role = 'review' THEN 'required' ELSE 'missing' END AS state, role FROM n""",
    "canonical_copies": """WITH s AS (SELECT c_custkey AS run, '/c/' || c_custkey * 5 AS path, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '9' END AS h, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 5) AS exact FROM customer),
      g AS (SELECT run, exact, any_value(s.path) AS own, count(o_orderkey) AS n, min('/c/' || o_orderkey) AS least, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (o_orderpriority = h) AS same, min('/c/' || o_orderkey) FILTER (o_orderpriority = h) AS least_same FROM s LEFT JOIN orders ON o_custkey = run GROUP BY 1, 2)
      SELECT run, CASE WHEN exact THEN own WHEN n = 1 THEN least WHEN same > 0 THEN least_same WHEN n > 1 AND kinds = 1 THEN least END AS path, CASE WHEN exact THEN 1 WHEN same > 0 THEN same ELSE n END AS n_matches,
        CASE WHEN exact THEN 'path' WHEN n = 1 THEN 'only' WHEN same = 1 THEN 'hash' WHEN same > 1 OR n > 1 AND kinds = 1 THEN 'content' END AS rule FROM g""",
}
