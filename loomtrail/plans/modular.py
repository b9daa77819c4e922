"""Queries over task modules; suppliers are nodes, nations their modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import graphs, modules
from loomtrail.plans.documents import _EDGES, _KEYS, TABLES, _columns, _edges, _tables, confirmed_keys
from loomtrail.plans.tables import table

OPS = ["retrieve", "aggregate", "filter", "create", "compare"]
RANKS = ["R0", "R1", "R2", "R3"]


def _op(c):
    return F.get(F.array(*map(F.lit, OPS)), (c % 5).cast("int"))


def _nodes(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") % 3).cast("string").alias("module"), F.col("s_suppkey").cast("string").alias("node"), _op(F.col("s_suppkey")).alias("op"))


def composed_edges(spark, d):
    n = _nodes(spark, d)
    e = _edges(spark, d).select((F.col("a") % 3).cast("string").alias("module"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (F.col("b") % 3).cast("string").alias("other"))
    return modules.composed(n, e.where("module = other"), e.where("module <> other").withColumnsRenamed({"module": "from_module", "other": "to_module"}))[1]


def subgraph_relations(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.array(F.concat(F.lit("app"), F.col("s_suppkey") % 4), F.concat(F.lit("app"), F.col("s_nationkey") % 5)).alias("surfaces"))
    return modules.subgraph(e, _edges(spark, d), ["app1", "app2"])[1]


def beam_search(spark, d):
    return modules.beam(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", F.col("p_partkey") % 3 == 0, 60, 8)


def composition_labels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    depth = graphs.depths(s, "node", _edges(spark, d), "a", "b").select(F.col("node").alias("b"), F.col("longest").alias("depth"))
    return _edges(spark, d).join(depth, "b").select("a", "b", modules.label(_op(F.col("a")), _op(F.col("b")), F.col("depth") + 1).alias("label"))


def downstream_values(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_name")
    return modules.downstream_values(s, _edges(spark, d), s.where("node = 2"))


def source_lineage(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 5, F.col("p_partkey") % 7).alias("parents"), F.col("p_brand").alias("operator"))
    return modules.lineage(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("source")))


def profile_scores(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *((F.col("p_size") * k % 10 / 10).alias(b) for k, b in ((3, "near"), (7, "far"))), (F.col("p_size") % 9).alias("depth"), (F.col("p_partkey") % 4).alias("cross_app"), F.col("p_size").alias("n_nodes"), (F.col("p_partkey") % 10 / 10).alias("ratio"), (F.col("p_partkey") % 3).alias("far_carries"), (F.col("p_partkey") % 2).alias("in_target"))
    return modules.profile_score(p, {"near": 0.25, "far": 0.75}, ["far"], (2, 5), 24, 0.5, 1)


def _ports(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("node"), F.col("l_suppkey").alias("port"), F.col("l_returnflag").alias("type"))


def port_type_report(spark, d):
    aliases = spark.createDataFrame([("A", "a"), ("N", "N")], "alias string, canonical string")
    return modules.port_types(_ports(spark, d).distinct(), aliases)


def class_breaches(spark, d):
    s = table(spark, d, "supplier")
    effects = table(spark, d, "events").select((F.col("user_id") % 10).alias("node"), F.concat(F.lit("R"), F.col("event_id") % 3).alias("class")).where("node % 4 <> 1")
    return modules.class_breaches(s.select(F.col("s_suppkey").alias("node"), _op(F.col("s_suppkey")).alias("op"), F.concat(F.lit("R"), F.col("s_suppkey") % 3).alias("declared")), effects, RANKS, ["create", "filter"])


def interface_breaches(spark, d):
    p = _ports(spark, d).groupBy("module", "node", "port").agg(F.min("type").alias("type"))
    return modules.interface_breaches(p.withColumns({"port": F.when(F.col("module") % 5 == 0, -1).otherwise(F.col("port")), "type": F.when(F.col("node") == 2, "Z").otherwise(F.col("type"))}), p)


def ungrounded_inputs(spark, d):
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 4 == 0, "upstream").otherwise("world").alias("source"), F.concat(F.lit("NATION_"), F.col("s_suppkey") * 4).alias("name"))
    return modules.ungrounded(i, table(spark, d, "nation").select(F.col("n_name").alias("entity")))


def _literals(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("literal"))


def literal_ports(spark, d):
    return modules.literal_ports(_literals(spark, d), spark.createDataFrame([("5-low",), ("1-Urgent",)], "literal string"))


def literals_in_order(spark, d):
    return modules.literals_in_order(_literals(spark, d), "task", "at")


def gold_read_facts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("table"), F.array(F.lit("a"), F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("c")).alias("columns"), F.array(F.col("o_orderkey") % 3, F.lit(7)).alias("entities"))
    return modules.read_facts(o)


def evaluated_agents(spark, d):
    return modules.agents(table(spark, d, "customer").select(F.col("c_mktsegment").alias("agent")), table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("agent")))


def review_sheet(spark, d):
    return modules.review_sheet(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("code")), "o_custkey", ["o_orderdate", "o_orderkey"], ["O", "P"])


def failing_tasks(spark, d):
    return modules.failing(table(spark, d, "customer").select(F.col("c_custkey").alias("task")), table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderkey") % 9 == 0, "auto_validated").otherwise("needs_review").alias("verdict")))


def typed_texts(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "text").when(F.col("event_id") % 3 == 1, "value").otherwise("key").alias("name"), F.concat(F.lit("  "), F.expr("substr(event_type, 1, cast(event_id % 6 as int))"), F.lit(" ")).alias("value"))
    return modules.typed_texts(e, ["text", "command", "value"])


def schema_prompt(spark, d):
    """A line per table with its number of rows, its columns and its confirmed keys."""
    tables, rows = _tables(spark, d), None
    for t, df in tables.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
        rows = own if rows is None else rows.union(own)
    return modules.schema_lines(_columns(spark, tables).withColumn("type", F.lit("t")), rows, confirmed_keys(spark, tables))


def statement_tables(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('SELECT * FROM "t'), F.col("o_orderkey") % 4, F.lit('" a join (select 1 from u'), F.col("o_orderkey") % 2, F.lit(") b LEFT JOIN t1 ON x")).alias("sql"))
    return o.select("o_orderkey", F.array_join(modules.sql_tables(F.col("sql")), ",").alias("tables"))


def entity_ids(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", modules.entity_id(F.col("c_mktsegment"), [F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("")], F.concat(F.lit("No "), "c_custkey")).alias("entity"))


QUERIES = {f.__name__: f for f in (composed_edges, subgraph_relations, beam_search, composition_labels, downstream_values, source_lineage, profile_scores, port_type_report, class_breaches, interface_breaches, ungrounded_inputs, literal_ports, literals_in_order,
    gold_read_facts, evaluated_agents, review_sheet, failing_tasks, typed_texts, schema_prompt, statement_tables, entity_ids)}

_P = "p AS (SELECT l_orderkey AS module, l_linenumber AS node, l_suppkey AS port, min(l_returnflag) AS type FROM lineitem GROUP BY 1, 2, 3)"

ORACLE = {
    "composed_edges": f"WITH {_EDGES} SELECT a % 3 || '.' || a AS a, b % 3 || '.' || b AS b FROM e",
    "subgraph_relations": f"WITH {_EDGES}, k AS (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey % 4 IN (1, 2) OR s_nationkey % 5 IN (1, 2)) SELECT a, b FROM e WHERE a IN (SELECT n FROM k) AND b IN (SELECT n FROM k)",
    "beam_search": "SELECT * FROM (SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) WHERE p_partkey % 3 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 8",
    "composition_labels": f"""WITH RECURSIVE {_EDGES}, r(node, k) AS (SELECT s_suppkey, 1::BIGINT FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM e) UNION SELECT b, k + 1 FROM r JOIN e ON node = a), dp AS (SELECT node, max(k) AS k FROM r GROUP BY 1), o AS (SELECT a, b, k, {OPS}[a % 5 + 1] AS x, {OPS}[b % 5 + 1] AS y FROM e JOIN dp ON node = b)
      SELECT a, b, CASE WHEN y IN ('compare', 'aggregate', 'decide') THEN 'fan_in_extension' WHEN x IN ('retrieve', 'resolve', 'filter') AND y IN ('retrieve', 'resolve', 'filter') THEN 'motif_repetition' WHEN k >= 3 THEN 'delayed_reuse' ELSE 'typed_grafting' END AS label FROM o""",
    "downstream_values": f"WITH RECURSIVE {_EDGES}, r(n) AS (SELECT 2::BIGINT UNION SELECT b FROM r JOIN e ON n = a) SELECT s_suppkey AS node, s_name FROM supplier WHERE s_suppkey IN (SELECT n FROM r)",
    "source_lineage": """SELECT p_partkey AS id, p_brand AS operator, a.n_name || CASE WHEN p_partkey % 7 <> p_partkey % 5 THEN ',' || b.n_name ELSE '' END AS sources FROM part JOIN nation a ON a.n_nationkey = p_partkey % 7 JOIN nation b ON b.n_nationkey = p_partkey % 5""",
    "profile_scores": """WITH x AS (SELECT p_partkey AS id, (p_size * 3 % 10) / 10 AS near, (p_size * 7 % 10) / 10 AS far, p_size % 9 AS depth, p_partkey AS k, p_size FROM part)
      SELECT id, round(near * 0.25::DOUBLE * 0.5::DOUBLE + far * 0.75::DOUBLE * 2::DOUBLE - 0.1::DOUBLE * greatest(2 - depth, depth - 5, 0) + 0.05::DOUBLE * (k % 4), 4) AS score, concat_ws(',', CASE WHEN k % 10 > 5 THEN 'INDEPENDENT_COMPONENTS' END, CASE WHEN k % 3 > 0 THEN 'DECORATIVE_CARRY' END, CASE WHEN k % 2 < 1 THEN 'NO_NODE_IN_TARGET_BUCKET' END, CASE WHEN p_size > 24 THEN 'TOO_MANY_NODES' END) AS rejections FROM x""",
    "port_type_report": "WITH q AS (SELECT DISTINCT l_orderkey AS module, l_linenumber AS n, l_suppkey AS s, l_returnflag AS t FROM lineitem) SELECT module, count(*) AS n_ports, count(*) FILTER (t = 'A') AS n_changed, coalesce(string_agg(n || ':' || s || ':R', ',' ORDER BY n || ':' || s || ':R') FILTER (t = 'R'), '') AS unregistered FROM q GROUP BY 1",
    "class_breaches": f"""WITH f AS (SELECT user_id % 10 AS node, max(event_id % 3) AS m FROM events WHERE user_id % 10 % 4 <> 1 GROUP BY 1), x AS (SELECT s_suppkey AS node, m, CASE WHEN m IS NOT NULL AND {OPS}[s_suppkey % 5 + 1] NOT IN ('create', 'filter') THEN 'effects of a reading node' WHEN coalesce(m, 0) <> s_suppkey % 3 THEN 'declared otherwise' END AS fault FROM supplier LEFT JOIN f ON node = s_suppkey)
      SELECT node, fault FROM x WHERE fault IS NOT NULL""",
    "interface_breaches": f"WITH {_P} SELECT module, node, CASE WHEN module % 5 = 0 THEN -1 ELSE port END AS port, CASE WHEN module % 5 = 0 THEN 'missing' ELSE 'type' END AS fault FROM p WHERE module % 5 = 0 OR node = 2",
    "ungrounded_inputs": "SELECT s_suppkey AS node, 'NATION_' || s_suppkey * 4 AS name FROM supplier WHERE s_suppkey % 4 <> 0 AND 'NATION_' || s_suppkey * 4 NOT IN (SELECT n_name FROM nation)",
    "literal_ports": """SELECT o_custkey AS task, o_orderkey AS "at", o_orderpriority AS literal FROM orders WHERE o_orderkey % 3 <> 0 AND lower(o_orderpriority) NOT IN ('5-low', '1-urgent')""",
    "literals_in_order": "WITH f AS (SELECT o_custkey AS task, o_orderpriority AS l, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2) SELECT task, string_agg(l, '|' ORDER BY k) AS literals FROM f GROUP BY 1",
    "gold_read_facts": """SELECT DISTINCT task, "table", c AS "column", unnest([k, 7]) AS entity FROM (SELECT o_custkey AS task, o_orderstatus AS "table", unnest(['a', CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'c' END]) AS c, o_orderkey % 3 AS k FROM orders)""",
    "evaluated_agents": "SELECT c_mktsegment AS agent FROM customer UNION SELECT l_returnflag FROM lineitem WHERE l_returnflag <> 'N'",
    "review_sheet": "SELECT o_custkey, o_orderstatus AS code, o_orderdate, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE o_orderstatus IN ('O', 'P')",
    "failing_tasks": "SELECT c_custkey AS task FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)",
    "typed_texts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE 'value' END AS name, left(event_type, (event_id % 6)::INT) AS value FROM events WHERE event_id % 3 < 2 AND length(left(event_type, (event_id % 6)::INT)) >= 3",
    "schema_prompt": f"""WITH {_KEYS}, n AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)}), g AS (SELECT from_table, string_agg(from_column || ' -> ' || to_table, ', ' ORDER BY from_column || ' -> ' || to_table) AS g FROM k GROUP BY 1)
      SELECT c.t AS "table", c.t || ' (' || any_value(n.n) || ' rows): ' || string_agg(c || ' t', ', ' ORDER BY p) || coalesce('; ' || any_value(g), '') AS line FROM c JOIN n ON n.t = c.t LEFT JOIN g ON from_table = c.t GROUP BY c.t""",
    "statement_tables": "SELECT o_orderkey, 't' || o_orderkey % 4 || ',u' || o_orderkey % 2 || CASE WHEN o_orderkey % 4 <> 1 THEN ',t1' ELSE '' END AS tables FROM orders",
    "entity_ids": "SELECT c_custkey, lower(c_mktsegment) || ':' || CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') ELSE 'no-' || c_custkey END AS entity FROM customer",
}
