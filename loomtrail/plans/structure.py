"""Queries over structure: repaired edges, cycles, compositions of modules and relations between tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtrail.operators import compositions, graphs, relations, repairs
from loomtrail.plans.tables import spread, table


def _chains(spark, d):
    """Edges and ports of a task per supplier: each line of its orders is a step that passes the value of the line before on.

    A step makes a value of its own where a line has the highest tax and no discount, takes a literal at the 50th
    quantity of the seventh line, feeds itself on some returned lines, and names an unknown port where the line is the first of its order and taxed most.
    """
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_returnflag")
    own = (F.col("l_tax") >= 0.08) & (F.col("l_discount") == 0)
    literal = (F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 25)
    steps = spread(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_returnflag"), "l_suppkey", repairs.TASKS).select(
        F.col("l_suppkey").alias("task"), F.row_number().over(w).cast("long").alias("node"), own.alias("own"), F.when(literal & ~own, F.concat(F.lit("v"), "l_orderkey")).alias("literal"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08) & ~own).alias("itself"), ((F.col("l_linenumber") == 1) & (F.col("l_tax") >= 0.08)).alias("unknown"), F.lag(own).over(w).alias("own_before"),
    )
    ports = steps.select("task", "node", F.when(F.col("own"), "out").otherwise("in").alias("port"), F.col("own").alias("is_output"), "literal")
    before = F.when(F.col("itself"), F.col("node")).otherwise(F.col("node") - 1)
    made = F.coalesce(F.when(~F.col("itself"), F.col("own_before")), F.lit(False))
    edges = steps.select("task", F.col("node").alias("edge"), before.alias("from_node"), F.when(F.col("unknown"), "none").when(made, "out").otherwise("in").alias("from_port"), F.col("node").alias("to_node"), F.lit("in").alias("to_port"))
    return edges.where("from_node > 0"), ports


def edge_repair(spark, d):
    return repairs.repair_edges(*_chains(spark, d), "task")


def edge_repair_step(spark, d):
    return repairs.repair_edges(*_chains(spark, d), "task", final=False).drop("hops")


def repaired_inputs(spark, d):
    edges, ports = _chains(spark, d)
    return repairs.repaired_inputs(ports, repairs.repair_edges(edges, ports, "task"), "task")


def cycle_members(spark, d):
    """Cycles of orders: each order points to its customer's next one, and an order whose status is not open to one or two before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.when(F.col("o_orderstatus") != "O", F.when(F.col("o_orderpriority") < "3", F.lag("o_orderkey", 2).over(w)).otherwise(F.lag("o_orderkey").over(w))).alias("back"), "o_orderpriority")
    ahead = o.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("a"), F.col("next").alias("b"))
    return graphs.cycle_members(ahead.union(o.select("o_orderkey", "back")), "a", "b")


def _fits(spark, d):
    """Suppliers as modules: one fits behind another where an order names them on lines next to each other, best by the quantity of the first."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    after = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_returnflag").alias("out"), F.lead("l_suppkey").over(w).alias("b"), F.lead("l_linestatus").over(w).alias("into"), F.col("l_quantity").cast("long").alias("q"))
    return compositions.best_fits(after.where("b is not null").groupBy("a", "out", "b", "into").agg(F.sum("q").alias("score")), 3)


def fitting_modules(spark, d):
    return _fits(spark, d)


def beam_rounds(spark, d):
    modules = table(spark, d, "supplier").select(F.col("s_suppkey").alias("module"), (F.col("s_nationkey") % 5 + 1).cast("long").alias("n_nodes"))
    out = compositions.beam_rounds(modules, _fits(spark, d), 3, 4, 12, F.col("score") % 7 != 0, 4, 14)
    return out.select("seed", "round", "form", F.array_join(F.array_sort(F.transform("members", lambda m: m.cast("string"))), ",").alias("modules"), "score", "n_nodes")


#: Columns of texts and vectors hold no references.
_TEXTS = frozenset({"text", "html", "embedding"})
_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"], "events": ["event_id", "user_id", "event_type", "props"],
    "documents": ["doc_id", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "pages": ["page_id", "url"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn", "role"], "embeddings": ["vec_id", "label"],
}


def _values(spark, d):
    return relations.column_values({name: table(spark, d, name) for name in _COLUMNS}, _TEXTS)


def column_sizes(spark, d):
    """Columns of whole numbers and texts with their distinct values, and whether they are a key."""
    return relations.column_sizes(_values(spark, d)).select("table", "column", "kind", F.col("size").alias("n_values"), (~F.col("twice")).alias("is_key"))


def inclusions(spark, d):
    return relations.inclusions(_values(spark, d), 0.8).withColumn("contained", F.round("contained", 9))


def table_relations(spark, d):
    return relations.relations(_values(spark, d), [("role", "conv_id"), ("event_type", "user_id")])


def _modules(spark, d):
    """Each supplier of a nation as a task of three steps, its lines telling the ports; joins follow orders that name two suppliers next to each other."""
    s = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS task", "s_nationkey")
    steps = s.select("*", F.explode(F.expr("sequence(1, 3)")).alias("k"))
    nodes = steps.selectExpr("task", "concat('n', k) AS node", "k AS place", "CASE WHEN (s_nationkey + k) % 3 = 0 THEN 'create' WHEN k = 2 THEN 'decide' ELSE 'retrieve' END AS op")
    ports = steps.selectExpr("task", "concat('n', k) AS node", "'in' AS port", "false AS is_output", "CASE WHEN k = 1 THEN concat('v', task) END AS literal", "CASE WHEN k = 1 THEN 'literal' ELSE 'upstream' END AS source", "CASE WHEN k = 1 THEN 'literal' ELSE concat('derived:n', k - 1, ':out') END AS grounding")
    ports = ports.union(steps.selectExpr("task", "concat('n', k)", "'out'", "true", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "'world'")).union(steps.where("k = 3 and s_nationkey % 4 = 0").selectExpr("task", "concat('n', k)", "'gate'", "false", "CAST(NULL AS STRING)", "'upstream'", "'x'"))
    edges = steps.where("k > 1").selectExpr("task", "concat('e', k) AS edge", "concat('n', k - 1) AS from_node", "'out' AS from_port", "concat('n', k) AS to_node", "'in' AS to_port", "'value_dependency' AS kind")
    fits = _fits(spark, d).selectExpr("CAST(a AS STRING) AS a", "CAST(b AS STRING) AS b").distinct()
    return nodes, ports, edges, fits


def _flat(tables):
    """The rows of a composition's tables as lines of text."""
    tasks, nodes, ports, edges = tables
    parts = [tasks.selectExpr("task", "concat_ws('|', 'task', a, b, operator) AS line"), nodes.selectExpr("task", "concat_ws('|', 'node', node, op) AS line"), ports.selectExpr("task", "concat_ws('|', 'port', node, port, is_output, coalesce(literal, '-'), coalesce(source, '-'), grounding) AS line"), edges.selectExpr("task", "concat_ws('|', 'edge', edge, from_node, from_port, to_node, to_port, kind) AS line")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def grafted_tasks(spark, d):
    nodes, ports, edges, fits = _modules(spark, d)
    joins = fits.selectExpr("a", "b", "'n3' AS from_node", "'out' AS from_port", "'n1' AS to_node", "'in' AS to_port")
    return _flat(compositions.grafted(joins, nodes, ports, edges))


def conditioned_tasks(spark, d):
    nodes, ports, edges, fits = _modules(spark, d)
    decide = nodes.where("op = 'decide'").select(F.col("task").alias("a"), F.col("node").alias("decide"))
    return _flat(compositions.conditioned(fits.join(decide, "a").withColumn("produce", F.lit("out")), nodes, ports, edges, ["create"]))


def composition_sources(spark, d):
    """Sources of compositions whose first parents are compositions of two suppliers themselves."""
    nodes, ports, edges, fits = _modules(spark, d)
    joins = fits.selectExpr("a", "b", "'n3' AS from_node", "'out' AS from_port", "'n1' AS to_node", "'in' AS to_port")
    tasks = compositions.grafted(joins, nodes, ports, edges)[0]
    inner = tasks.select("task", F.posexplode(F.array("a", "b")).alias("place", "source")).withColumn("prefix", F.when(F.col("place") == 0, compositions.FIRST).otherwise(compositions.SECOND))
    outer = tasks.select(F.concat(F.lit("x"), "task").alias("task"), F.col("task").alias("a"), "b")
    out = compositions.composed_lineage(outer, inner)
    return out.select("task", F.array_join("sources", ",").alias("sources"), F.array_join("prefixes", ",").alias("prefixes"))


QUERIES = {f.__name__: f for f in (grafted_tasks, conditioned_tasks, composition_sources, edge_repair, edge_repair_step, repaired_inputs, cycle_members, fitting_modules, beam_rounds, column_sizes, inclusions, table_relations)}

_CHAINS = """s0 AS (SELECT l_suppkey AS task, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount, l_returnflag) AS node, l_tax >= 0.08 AND l_discount = 0 AS own, l_linenumber = 7 AND l_quantity >= 25 AS lit, * FROM lineitem),
  s AS (SELECT task, node, own, CASE WHEN lit AND NOT own THEN 'v' || l_orderkey END AS literal, l_returnflag = 'R' AND l_tax >= 0.08 AND NOT own AS itself, l_linenumber = 1 AND l_tax >= 0.08 AS unknown FROM s0),
  e AS (SELECT task, node, node AS edge, CASE WHEN itself THEN node ELSE node - 1 END AS src, CASE WHEN unknown THEN 'none' WHEN NOT itself AND lag(own) OVER (PARTITION BY task ORDER BY node) THEN 'out' ELSE 'in' END AS port FROM s)"""
# each edge is walked back link by link to where its value comes from
_WALK = f"""{_CHAINS},
  pass AS (SELECT e.task, e.node, e.src, e.port FROM e JOIN s USING (task, node) WHERE NOT own AND literal IS NULL AND src > 0 AND src <> e.node),
  w(task, edge, n, p, hops) AS (SELECT task, edge, src, port, 0::BIGINT FROM e WHERE src > 0 UNION ALL SELECT w.task, w.edge, pass.src, pass.port, hops + 1 FROM w JOIN pass ON pass.task = w.task AND pass.node = w.n AND w.p = 'in'),
  z AS (SELECT task, edge, arg_max(n, hops) AS n, arg_max(p, hops) AS p, max(hops) AS hops FROM w GROUP BY ALL),
  r AS (SELECT e.*, z.n, z.p, z.hops, x.literal AS value, CASE WHEN e.src = e.node THEN 'dropped_self_edge' WHEN x.literal IS NOT NULL THEN 'literal_copied' WHEN z.hops > 0 THEN 'rewired_to_producer' ELSE 'kept' END AS repair
    FROM e JOIN z USING (task, edge) LEFT JOIN s x ON x.task = e.task AND x.node = z.n AND z.p = 'in')"""
_VALUES = "v AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", k AS kind, CASE WHEN k = 'text' AND length(x) > {relations.LONG} THEN md5(x) ELSE x END AS value, n
    FROM (SELECT "{c}"::VARCHAR AS x, CASE WHEN typeof(any_value("{c}")) = 'VARCHAR' THEN 'text' ELSE 'number' END AS k, count(*) AS n FROM {t} WHERE "{c}" IS NOT NULL GROUP BY "{c}")"""
    for t, cols in _COLUMNS.items() for c in cols) + ')'
_INSIDE = f"""{_VALUES}, k AS (SELECT "table", "column", kind, count(*) AS size, max(n) AS most FROM v GROUP BY ALL),
  x AS (SELECT a."table" AS from_table, a."column" AS from_column, b."table" AS to_table, b."column" AS to_column, count(*) AS met FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a."table" <> b."table"
    JOIN k ON k."table" = b."table" AND k."column" = b."column" AND k.most = 1 GROUP BY ALL),
  y AS (SELECT x.*, f.size, f.most, t.size AS n FROM x JOIN k f ON f."table" = from_table AND f."column" = from_column JOIN k t ON t."table" = to_table AND t."column" = to_column)"""
_STEM = "coalesce(nullif(regexp_extract({0}, '^[a-z]+_(.+)$', 1), ''), {0})"
_MODULES = """l AS (SELECT l_suppkey AS a, l_returnflag AS o, lead(l_suppkey) OVER w AS b, lead(l_linestatus) OVER w AS i, l_quantity::BIGINT AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus)),
  g AS (SELECT a, o, b, i, sum(q) AS score FROM l WHERE b IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY a, o ORDER BY score DESC, b, i) <= 3 OR row_number() OVER (PARTITION BY b, i ORDER BY score DESC, a, o) <= 3),
  j AS (SELECT DISTINCT a::VARCHAR AS a, b::VARCHAR AS b FROM t WHERE a <> b), s AS (SELECT s_suppkey::VARCHAR AS t, s_nationkey AS c, unnest([1, 2, 3]) AS k FROM supplier),
  n AS (SELECT t, k, 'n' || k AS node, CASE WHEN (c + k) % 3 = 0 THEN 'create' WHEN k = 2 THEN 'decide' ELSE 'retrieve' END AS op FROM s),
  p AS (SELECT t, 'n' || k AS node, 'in' AS port, 'false' AS o, CASE WHEN k = 1 THEN 'v' || t ELSE '-' END AS lit, CASE WHEN k = 1 THEN 'literal' ELSE 'upstream' END AS src, CASE WHEN k = 1 THEN 'literal' ELSE 'derived:n' || k - 1 || ':out' END AS g FROM s
    UNION ALL SELECT t, 'n' || k, 'out', 'true', '-', '-', 'world' FROM s UNION ALL SELECT t, 'n3', 'gate', 'false', '-', 'upstream', 'x' FROM s WHERE k = 3 AND c % 4 = 0),
  e AS (SELECT t, 'e' || k AS edge, 'n' || k - 1 AS f, 'n' || k AS h FROM s WHERE k > 1),
  u AS (SELECT *, 'gen-' || left(sha256(a || '|' || b || '|a_n3.out->b_n1.in'), 10) AS task FROM j),
  v AS (SELECT j.*, d.node AS decide, x.gated, 'gen-' || left(sha256('cond|' || a || '|' || b || '|' || d.node), 10) AS task FROM j JOIN n d ON d.t = a AND d.op = 'decide' JOIN (SELECT t, arg_min(node, k) AS gated FROM n WHERE op = 'create' GROUP BY t) x ON x.t = b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = b AND p.node = x.gated AND p.port = 'gate'))"""


def _flat_sql(pairs: str, operator: str, more: str, port: str) -> str:
    return f"""SELECT task, 'task|' || a || '|' || b || '|{operator}' AS line FROM {pairs}
      UNION ALL SELECT task, 'node|a_' || node || '|' || op FROM {pairs} JOIN n ON t = a UNION ALL SELECT task, 'node|b_' || node || '|' || op FROM {pairs} JOIN n ON t = b
      UNION ALL SELECT task, concat_ws('|', 'port', 'a_' || node, port, o, lit, src, g) FROM {pairs} JOIN p ON t = a UNION ALL SELECT task, {port} FROM {pairs} JOIN p ON t = b
      UNION ALL SELECT task, concat_ws('|', 'edge', edge, 'a_' || f, 'out', 'a_' || h, 'in', 'value_dependency') FROM {pairs} JOIN e ON t = a UNION ALL SELECT task, concat_ws('|', 'edge', edge, 'b_' || f, 'out', 'b_' || h, 'in', 'value_dependency') FROM {pairs} JOIN e ON t = b {more}"""


_SECOND_PORT = "concat_ws('|', 'port', 'b_' || node, port, o, lit, src, g)"
ORACLE = {
    "grafted_tasks": f"""WITH {_MODULES} {_flat_sql('u', 'grafting', "UNION ALL SELECT task, 'edge|graft_a_n3_b_n1|a_n3|out|b_n1|in|data_dependency' FROM u", f"CASE WHEN node = 'n1' AND port = 'in' THEN 'port|b_n1|in|false|-|upstream|derived:a_n3:out' ELSE {_SECOND_PORT} END")}""",
    "conditioned_tasks": f"""WITH {_MODULES} {_flat_sql('v', 'conditionalization', "UNION ALL SELECT task, concat_ws('|', 'edge', 'cond_b_' || gated, 'a_' || decide, 'out', 'b_' || gated, 'gate', 'control_dependency') FROM v UNION ALL SELECT task, concat_ws('|', 'port', 'b_' || gated, 'gate', 'false', '-', 'upstream', 'derived:a_' || decide || ':out') FROM v", _SECOND_PORT)}""",
    "composition_sources": f"""WITH {_MODULES} SELECT 'x' || task AS task, a || ',' || b || ',' || b AS sources, 'a_a_,a_b_,b_' AS prefixes FROM u""",
    "fitting_modules": """WITH l AS (SELECT l_suppkey AS a, l_returnflag AS "out", lead(l_suppkey) OVER w AS b, lead(l_linestatus) OVER w AS "into", l_quantity::BIGINT AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus)),
      f AS (SELECT a, "out", b, "into", sum(q)::BIGINT AS score FROM l WHERE b IS NOT NULL GROUP BY ALL)
      SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY a, "out" ORDER BY score DESC, b, "into") <= 3 OR row_number() OVER (PARTITION BY b, "into" ORDER BY score DESC, a, "out") <= 3""",
    "column_sizes": f"""WITH {_VALUES} SELECT "table", "column", kind, count(*) AS n_values, max(n) = 1 AS is_key FROM v GROUP BY ALL""",
    "inclusions": f"""WITH {_INSIDE} SELECT from_table, from_column, to_table, to_column, round(met / size, 9) AS contained, size FROM y WHERE met >= 0.8 * size - 1e-9""",
    "table_relations": f"""WITH {_INSIDE}, z AS (SELECT *, {_STEM.format('from_column')} = {_STEM.format('to_column')} AS same FROM y WHERE met = size),
      b AS (SELECT * FROM z WHERE same OR most > 1 QUALIFY row_number() OVER (PARTITION BY from_table, from_column ORDER BY same DESC, n, to_table, to_column) = 1),
      p AS (SELECT * FROM (VALUES ('conversations', 'conv_id', 'role'), ('events', 'user_id', 'event_type')) p(from_table, from_column, type_column))
      SELECT from_table, from_column, to_table, to_column, CASE WHEN same THEN 'name' ELSE 'values' END AS rule, round(met / size, 9) AS confidence, NULL::VARCHAR AS type_column FROM b ANTI JOIN p USING (from_table, from_column)
      UNION ALL SELECT from_table, from_column, NULL, NULL, 'polymorphic', 0.5, type_column FROM p""",
    "edge_repair": f"""WITH RECURSIVE {_WALK}
      SELECT task, edge, repair, CASE WHEN repair = 'rewired_to_producer' THEN n ELSE src END AS from_node, CASE WHEN repair = 'rewired_to_producer' THEN p ELSE port END AS from_port, node AS to_node, 'in' AS to_port,
        CASE WHEN repair = 'literal_copied' THEN value END AS literal, CASE WHEN repair IN ('literal_copied', 'rewired_to_producer') THEN hops ELSE 0 END AS hops FROM r""",
    "edge_repair_step": f"""WITH {_CHAINS}, r AS (SELECT e.*, x.literal AS value, f.src AS n, f.port AS p,
        CASE WHEN e.src = e.node THEN 'dropped_self_edge' WHEN e.port <> 'in' THEN 'kept' WHEN x.literal IS NOT NULL THEN 'literal_copied' WHEN f.src > 0 AND f.src <> f.node THEN 'rewired_to_producer' ELSE 'kept' END AS repair
        FROM e LEFT JOIN s x ON x.task = e.task AND x.node = e.src LEFT JOIN e f ON f.task = e.task AND f.node = e.src WHERE e.src > 0)
      SELECT task, edge, repair, CASE WHEN repair = 'rewired_to_producer' THEN n ELSE src END AS from_node, CASE WHEN repair = 'rewired_to_producer' THEN p ELSE port END AS from_port, node AS to_node, 'in' AS to_port,
        CASE WHEN repair = 'literal_copied' THEN value END AS literal FROM r""",
    "repaired_inputs": f"""WITH RECURSIVE {_WALK}
      SELECT s.task, s.node, CASE WHEN own THEN 'out' ELSE 'in' END AS port, own AS is_output, CASE WHEN own THEN literal ELSE coalesce(CASE WHEN repair = 'literal_copied' THEN value END, literal) END AS literal
      FROM s LEFT JOIN r ON r.task = s.task AND r.node = s.node WHERE own OR repair IS NULL OR repair <> 'dropped_self_edge'""",
    "cycle_members": """WITH RECURSIVE o AS (SELECT o_orderkey, o_orderpriority AS pr, o_orderstatus AS st, lead(o_orderkey) OVER w AS nxt, lag(o_orderkey) OVER w AS b1, lag(o_orderkey, 2) OVER w AS b2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
      e AS (SELECT o_orderkey AS a, nxt AS b FROM o WHERE pr < '4' AND nxt IS NOT NULL UNION SELECT o_orderkey, CASE WHEN pr < '3' THEN b2 ELSE b1 END FROM o WHERE st <> 'O' AND CASE WHEN pr < '3' THEN b2 ELSE b1 END IS NOT NULL),
      r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      c AS (SELECT x.a AS node, min(y.a) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
      SELECT node, component, count(*) OVER (PARTITION BY component) AS members FROM c""",
}
