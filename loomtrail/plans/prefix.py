"""Queries over runs that are cut, repaired, compared and chosen, and over graphs' measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import changes, graphs, metrics, prefixes
from loomtrail.plans.documents import _EDGES, _edges
from loomtrail.plans.tables import EV, indexed_events, table

DEPTHS = [0, 2, 5]


def _steps(spark, d):
    return indexed_events(spark, d).select(F.col("user_id").alias("run"), F.col("idx").alias("at"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("before"), (F.col("event_id") + 1).cast("string").alias("after"), "value")


def _roots(spark, d):
    return _steps(spark, d).groupBy("run").agg((F.max("at") / 3).cast("long").alias("root"), (F.max("at") * 2 / 3).cast("long").alias("shows"))


def patched_steps(spark, d):
    s = _steps(spark, d)
    p = s.where("run % 2 = 0 and at % 7 = 3").select("run", "at", F.when(F.col("at") % 2 == 0, "drop").otherwise("replace").alias("operation"), F.col("action").alias("old_action"), F.lit("fixed").alias("new_action"))
    return prefixes.patched(s, p, "run", "at", "action", ["before", "after"]).drop("value")


def _renumbered(spark, d):
    s = _steps(spark, d)
    return prefixes.renumbered(s, s.where("at % 4 = 1").select("run", "at"), _roots(spark, d).select("run", "root"), "run", "at")


def renumbered_prefix(spark, d):
    return _renumbered(spark, d).select("run", "at", F.col("place").cast("long").alias("place"))


def depth_cases(spark, d):
    out = prefixes.depth_cases(_renumbered(spark, d), _roots(spark, d), "run", "at", DEPTHS)
    return out.select("run", "depth", *(F.col(c).cast("long").alias(c) for c in ("root_place", "shows_place", "ends")))


def tail_differences(spark, d):
    s = _steps(spark, d)
    fixed = s.where("at % 11 <> 6").withColumn("action", F.when((F.col("at") % 9 == 4) | (F.col("at") < 2), "other").otherwise(F.col("action")))
    return prefixes.tail_differences(s, fixed, _roots(spark, d).select("run", "root"), "run", "at", ["action", "before"])


def replay_mismatches(spark, d):
    s = _steps(spark, d).select("run", "at", "action")
    log = s.where("at % 5 <> 2").withColumn("action", F.when(F.col("at") % 6 == 3, "x").otherwise(F.col("action")))
    return prefixes.replay_mismatches(s, log, s.where("at % 8 <> 7").withColumn("action", F.when(F.col("at") % 10 == 4, "y").otherwise(F.col("action"))), "run", "at", "action")


def undeclared_writes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("table"), F.sha2(F.col("n_regionkey").cast("string"), 256).alias("digest"))
    after = n.where("table <> 'NATION_3'").withColumn("digest", F.when(F.col("table").endswith("1"), "changed").otherwise(F.col("digest")))
    return prefixes.undeclared_writes(n, after, n.where("table = 'NATION_11'"), "table", "digest")


def agreed_ranges(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("reviewer"), F.when(F.col("l_linestatus") == "F", 3).otherwise(6).cast("long").alias("index"))
    return prefixes.agreed(l.withColumn("until", F.col("index") + F.col("case") % 4), "case", "reviewer", "index", "until", 2)


def first_equivalents(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("fact"), F.col("p_brand").alias("value"))
    links = p.where("fact % 3 = 0").select(F.col("fact").alias("a"), (F.col("fact") + 7).alias("b"), F.when(F.col("fact") % 2 == 0, "exact").otherwise("contains").alias("rule"))
    seen = table(spark, d, "part").where("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("fact"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("a "), F.col("p_brand"))).otherwise(F.col("p_brand")).alias("value"), F.col("p_size").alias("at"))
    return prefixes.first_equivalent(p, seen, links)


def touching_edges(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("task"), F.col("s_suppkey").alias("port"), F.when(F.col("s_suppkey") % 2 == 0, "out").otherwise("in").alias("direction"), (F.col("s_suppkey") % 5).alias("type"))
    return prefixes.touching(s.where("port % 4 in (0, 1)"), s.where("port % 4 in (2, 3)"))


def other_rows(spark, d):
    return prefixes.other_row(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 5)


def _selection(spark, d, *more):
    o = table(spark, d, "orders").withColumn("run", F.col("o_orderkey"))
    runs = o.select("run", (F.col("run") % 11 != 0).alias("complete"), (F.col("run") % 13 != 0).alias("provenance"), F.when(F.col("run") % 17 == 0, "b").otherwise("a").alias("agent"), (F.col("run") * 3).alias("sha"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("annotator"), (F.col("l_orderkey") * 3 + (F.col("l_linenumber") == 2).cast("int")).alias("sha"), "l_linenumber", "l_linestatus")
    marks = l.groupBy("run", "annotator", "sha").agg(F.min("l_linestatus").alias("label"), F.min("l_linenumber").alias("k"))
    reviews = marks.select("run", F.col("annotator").alias("reviewer"), "sha", (F.col("k") == 3).alias("success"))
    flags = marks.where("annotator = 'N' and run % 2 = 0").select("run", "annotator", "sha")
    settled = runs.where("run % 3 = 0").select("run", F.lit("O").alias("label"))
    return prefixes.selection(runs, marks.select("run", "annotator", "sha", "label"), reviews, flags, "a", settled, *more)


def takeover_selection(spark, d):
    return _selection(spark, d)


def takeover_reasons(spark, d):
    """With repaired prefixes asked for, and with the runs of reviews that no order stands behind."""
    o = table(spark, d, "orders")
    repaired = o.where("o_custkey % 7 <> 3").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") * 3 + (F.col("o_custkey") % 9 == 1).cast("int")).alias("sha"))
    rejected = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 7, 10_000_000_000).otherwise(0)).alias("run"), F.col("l_returnflag").alias("annotator"))
    return _selection(spark, d, repaired, rejected)


def exclusion_counts(spark, d):
    """Runs by reason of exclusion; those that were chosen have none."""
    return takeover_selection(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def judgeable_episodes(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3 * 5).alias("depth"), F.col("o_orderpriority").alias("condition"), F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    key = ["depth", "condition", "task"]
    files = o.where("task % 4 <> 0").select(*key, F.when(F.col("task") % 2 == 0, "rubric.json").otherwise("log.txt").alias("file"))
    return prefixes.judgeable(o.distinct(), o.where("task % 10 = 6 and depth = 5"), files, key, "rubric.json").select(*key)


def capped_hazards(spark, d):
    return prefixes.capped(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", [(F.col("event_type") != "error").asc(), F.col("event_type"), F.col("event_id")], 4)


def bucket_fill(spark, d):
    quotas = table(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey")).alias("p_brand"), (F.col("n_nationkey") * 2).cast("long").alias("quota"))
    return prefixes.bucket_fill(table(spark, d, "part").where("p_size > 20"), "p_brand", quotas)


def cell_summary(spark, d):
    """Pass at 2 by depth and condition: units, solved ones and the mean score."""
    o = table(spark, d, "orders").select(F.concat_ws("/", F.col("o_orderkey") % 3 * 5, "o_orderstatus", F.col("o_custkey") % 20).alias("unit"), (F.col("o_orderkey") % 3 * 5).alias("depth"), F.col("o_orderstatus").alias("condition"), (F.floor(F.col("o_orderkey") / 60) % 4 + 1).cast("int").alias("run"), (F.col("o_orderkey") % 7 == 0).alias("passed"), (F.col("o_orderkey") % 10 / 10).alias("score"))
    runs = o.groupBy("unit", "run").agg(F.bool_or("passed").alias("passed"), F.max("score").alias("score"))
    per = metrics.pass_at_k(o.select("unit").distinct(), runs, "unit", 2).join(o.select("unit", "depth", "condition").distinct(), "unit")
    return per.groupBy("depth", "condition").agg(F.count("*").alias("n_units"), F.count_if("solved").alias("n_solved"), F.round(F.avg("score"), 9).alias("mean_score"))


def workflow_manifest(spark, d):
    """Samples by kind and split with the workflows that they come from, an id's part before #."""
    o = table(spark, d, "orders").select(F.concat_ws("#", F.col("o_custkey") % 40, "o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_custkey") % 40 < 8, "test").otherwise("train").alias("split"))
    return o.groupBy("kind", "split").agg(F.count("*").alias("n"), F.countDistinct(F.split_part("id", F.lit("#"), F.lit(1))).alias("n_workflows"))


def duplicate_base_rate(spark, d):
    """How many names several parts share, and how many parts those are."""
    n = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("n_groups"), F.sum("n").cast("long").alias("n_rows"))


def cursor_upsert(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("seq"))
    return changes.upsert(s.where("user_id % 2 = 0").withColumn("seq", F.lit(7).cast("long")), s.where("user_id % 3 <> 1"), ["user_id"], ["seq"])


def path_lengths(spark, d):
    return graphs.path_lengths(_edges(spark, d), "a", "b")


def carry_distances(spark, d):
    return graphs.carry_distances(_edges(spark, d), "a", "b", 3)


def component_ratio(spark, d):
    e = _edges(spark, d).where("a % 3 <> 1")
    return graphs.component_ratio(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), "node", e, "a", "b")


def graph_complexity(spark, d):
    apps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("app"), (F.col("s_suppkey") % 6 == 5).alias("irreversible"))
    return graphs.complexity(apps, _edges(spark, d), "a", "b")


def semantic_horizon(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("root"), (F.col("s_suppkey") * 7 % 10).alias("shown"))
    return graphs.semantic_horizon(s, _edges(spark, d), "a", "b")


QUERIES = {f.__name__: f for f in (patched_steps, renumbered_prefix, depth_cases, tail_differences, replay_mismatches, undeclared_writes, agreed_ranges, first_equivalents, touching_edges, other_rows, takeover_selection, takeover_reasons, exclusion_counts, judgeable_episodes,
    capped_hazards, bucket_fill, cell_summary, workflow_manifest, duplicate_base_rate, cursor_upsert, path_lengths, carry_distances, component_ratio, graph_complexity, semantic_horizon)}

_S = f"""{EV}, s AS (SELECT user_id AS run, idx AS "at", event_type AS action, event_id::VARCHAR AS before, (event_id + 1)::VARCHAR AS after FROM ev), r AS (SELECT run, max("at") // 3 AS root, max("at") * 2 // 3 AS shows FROM s GROUP BY 1)"""
_N = f"""{_S}, n AS (SELECT s.run, "at", row_number() OVER (PARTITION BY s.run ORDER BY "at") - 1 AS place FROM s JOIN r USING (run) WHERE NOT ("at" % 4 = 1 AND "at" < root))"""
_SELECT = """r AS (SELECT o_orderkey AS run, o_orderkey * 3 AS sha FROM orders), l AS (SELECT l_orderkey AS run, l_returnflag AS who, l_orderkey * 3 + (l_linenumber = 2)::INT AS sha, l_linenumber, l_linestatus FROM lineitem),
  m AS (SELECT run, who, sha, min(l_linestatus) AS label, min(l_linenumber) AS k FROM l GROUP BY 1, 2, 3), f AS (SELECT DISTINCT run, who FROM m JOIN r USING (run, sha) WHERE who = 'N' AND run % 2 = 0),
  v AS (SELECT m.* FROM m JOIN r USING (run, sha) WHERE k <> 3 AND NOT EXISTS (SELECT 1 FROM f WHERE f.run = m.run AND f.who = m.who)),
  p AS (SELECT run, CASE WHEN count(DISTINCT label) = 1 THEN min(label) WHEN run % 3 = 0 AND bool_or(label = 'O') THEN 'O' END AS label FROM v GROUP BY run),
  z AS (SELECT r.run, CASE WHEN r.run % 11 = 0 THEN 'incomplete_canonical' WHEN r.run % 13 = 0 THEN 'provenance_mismatch' WHEN r.run % 17 = 0 THEN 'source_agent_mismatch' WHEN p.run IS NULL AND r.run IN (SELECT run FROM f) THEN 'wrong_rollout'
    WHEN p.run IS NULL THEN 'no_human_failure_annotation' WHEN label IS NULL THEN 'ambiguous_human_failure_annotations' END AS reason, label FROM r LEFT JOIN p ON p.run = r.run)"""
_PATHS = f"{_EDGES}, w(a, b, n) AS (SELECT a, b, 1::BIGINT FROM e UNION SELECT w.a, e.b, n + 1 FROM w JOIN e ON w.b = e.a)"

ORACLE = {
    "patched_steps": f"""WITH {_S}, f AS (SELECT run, min("at") AS first FROM s WHERE run % 2 = 0 AND "at" % 7 = 3 GROUP BY 1), x AS (SELECT s.*, first, run % 2 = 0 AND "at" % 7 = 3 AS p FROM s LEFT JOIN f USING (run))
      SELECT run, "at", CASE WHEN p THEN 'fixed' ELSE action END AS action, CASE WHEN "at" > first THEN NULL ELSE before END AS before, CASE WHEN "at" >= first THEN NULL ELSE after END AS after, p AS repaired FROM x WHERE NOT (p AND "at" % 2 = 0)""",
    "renumbered_prefix": f"WITH {_N} SELECT * FROM n",
    "depth_cases": f"""WITH {_N}, g AS (SELECT r.run, root.place AS root_place, (SELECT max(place) FROM n WHERE n.run = r.run AND "at" <= shows) AS shows_place, (SELECT max(place) FROM n WHERE n.run = r.run) AS last FROM r JOIN n root ON root.run = r.run AND root."at" = r.root)
      SELECT run, depth, root_place, shows_place, root_place + depth AS ends FROM (SELECT *, unnest({DEPTHS}) AS depth FROM g) WHERE root_place + depth <= last AND root_place + depth <= shows_place""",
    "tail_differences": f"""WITH {_S}, x AS (SELECT s.run, "at", action, before, CASE WHEN "at" % 9 = 4 OR "at" < 2 THEN 'other' ELSE action END AS now FROM s JOIN r USING (run) WHERE "at" >= root)
      SELECT run, "at", '{{"action":"' || action || '","before":"' || before || '"}}' AS original, CASE WHEN "at" % 11 <> 6 THEN '{{"action":"' || now || '","before":"' || before || '"}}' END AS repaired FROM x WHERE now <> action OR "at" % 11 = 6""",
    "replay_mismatches": f"""WITH {_S} SELECT run, "at", CASE WHEN "at" % 5 = 2 THEN 'not replayed' WHEN "at" % 8 = 7 THEN 'not in the history' WHEN "at" % 6 = 3 THEN 'replayed otherwise' ELSE 'other history' END AS fault FROM s WHERE "at" % 5 = 2 OR "at" % 8 = 7 OR "at" % 6 = 3 OR "at" % 10 = 4""",
    "undeclared_writes": """SELECT n_name AS "table" FROM nation WHERE (n_name LIKE '%1' OR n_name = 'NATION_3') AND n_name <> 'NATION_11'""",
    "agreed_ranges": """WITH l AS (SELECT DISTINCT l_orderkey AS c, l_returnflag AS w, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 6 END AS i, (CASE WHEN l_linestatus = 'F' THEN 3 ELSE 6 END + l_orderkey % 4)::BIGINT AS u FROM lineitem),
      e AS (SELECT c, w, string_agg('{"index":' || i || ',"until":' || u || '}', ',' ORDER BY i, u) AS r, count(*) AS n, bool_and(ok) AS ok FROM (SELECT *, coalesce(u < lead(i) OVER (PARTITION BY c, w ORDER BY i, u), true) AS ok FROM l) GROUP BY 1, 2)
      SELECT c AS "case", count(*) AS reviewers, min(n)::INT AS n_ranges, '[' || min(r) || ']' AS ranges FROM e GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT r) = 1 AND bool_and(ok)""",
    "first_equivalents": """WITH k AS (SELECT p_partkey AS a, p_partkey + 7 AS b, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'contains' END AS rule FROM part WHERE p_partkey % 3 = 0), w AS (SELECT a AS fact, b AS other, rule FROM k UNION SELECT b, a, rule FROM k UNION SELECT p_partkey, p_partkey, 'exact' FROM part),
      s AS (SELECT p_partkey AS other, CASE WHEN p_partkey % 5 = 0 THEN 'a ' || p_brand ELSE p_brand END AS shown, p_size AS "at" FROM part WHERE p_partkey % 4 <> 1),
      h AS (SELECT p_partkey AS fact, "at", other FROM part JOIN w ON fact = p_partkey JOIN s USING (other) WHERE CASE WHEN rule = 'contains' THEN contains(lower(shown), lower(p_brand)) ELSE shown = p_brand END QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY "at", other) = 1)
      SELECT p_partkey AS fact, "at", other AS seen_as FROM part LEFT JOIN h ON fact = p_partkey""",
    "touching_edges": """WITH s AS (SELECT s_nationkey AS task, s_suppkey AS port, s_suppkey % 2 = 0 AS o, s_suppkey % 5 AS type, s_suppkey % 4 IN (0, 1) AS st FROM supplier)
      SELECT a.task AS source, a.port AS source_port, b.task AS target, b.port AS target_port, CASE WHEN a.st THEN 'to pool' ELSE 'from pool' END AS way FROM s a JOIN s b ON a.o AND NOT b.o AND a.type = b.type AND a.st <> b.st AND a.task <> b.task""",
    "takeover_selection": f"WITH {_SELECT} SELECT run, reason, CASE WHEN reason IS NULL THEN label END AS label FROM z",
    "takeover_reasons": f"""WITH {_SELECT}, q AS (SELECT o_orderkey AS run, o_custkey % 7 <> 3 AND o_custkey % 9 <> 1 AS fixed FROM orders)
      SELECT run, CASE WHEN reason IS NULL AND NOT fixed THEN 'no_verified_repaired_prefix' ELSE reason END AS reason, CASE WHEN reason IS NULL AND fixed THEN label END AS label FROM z JOIN q USING (run)
      UNION ALL SELECT DISTINCT l_orderkey + 10000000000, 'canonicalization_rejected', NULL FROM lineitem WHERE l_partkey % 50 = 7""",
    "exclusion_counts": f"WITH {_SELECT} SELECT reason, count(*) AS n FROM z GROUP BY 1",
    "judgeable_episodes": """WITH o AS (SELECT DISTINCT o_orderkey % 3 * 5 AS depth, o_orderpriority AS condition, o_custkey AS task, o_orderstatus = 'F' AS done FROM orders) SELECT depth, condition, task FROM o WHERE done AND task % 2 = 0 AND task % 4 <> 0 AND NOT (task % 10 = 6 AND depth = 5)""",
    "capped_hazards": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', event_type, event_id) <= 4",
    "bucket_fill": "SELECT 'Brand#' || n_nationkey AS p_brand, (n_nationkey * 2)::BIGINT AS quota, count(p_partkey) AS filled, greatest(n_nationkey * 2 - count(p_partkey), 0)::BIGINT AS short FROM nation LEFT JOIN part ON p_brand = 'Brand#' || n_nationkey AND p_size > 20 GROUP BY n_nationkey",
    "cell_summary": """WITH o AS (SELECT o_orderkey % 3 * 5 AS depth, o_orderstatus AS condition, o_custkey % 20 AS t, o_orderkey // 60 % 4 + 1 AS run, o_orderkey % 7 = 0 AS passed, (o_orderkey % 10) / 10 AS score FROM orders), q AS (SELECT depth, condition, t, run, bool_or(passed) AS passed, max(score) AS score FROM o GROUP BY 1, 2, 3, 4),
      p AS (SELECT depth, condition, t, coalesce(bool_or(passed) FILTER (run <= 2), false) AS solved, coalesce(arg_min(score, run) FILTER (passed AND run <= 2), max(score) FILTER (run <= 2), 0) AS score FROM q GROUP BY 1, 2, 3)
      SELECT depth, condition, count(*) AS n_units, count(*) FILTER (solved) AS n_solved, round(avg(score), 9) AS mean_score FROM p GROUP BY 1, 2""",
    "workflow_manifest": "SELECT o_orderstatus AS kind, CASE WHEN o_custkey % 40 < 8 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT o_custkey % 40) AS n_workflows FROM orders GROUP BY 1, 2",
    "duplicate_base_rate": "SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) > 1)",
    "cursor_upsert": "SELECT user_id, CASE WHEN user_id % 3 <> 1 THEN max(event_id) ELSE 7 END::BIGINT AS seq FROM events WHERE user_id % 2 = 0 OR user_id % 3 <> 1 GROUP BY 1",
    "path_lengths": f"WITH RECURSIVE {_PATHS} SELECT a AS source, b AS target, min(n) AS length FROM w GROUP BY 1, 2",
    "carry_distances": f"WITH RECURSIVE {_PATHS} SELECT e.a AS source, e.b AS target, max(n) AS distance, max(n) >= 3 AS far FROM e JOIN w ON w.a = e.a AND w.b = e.b GROUP BY 1, 2",
    "component_ratio": f"""WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e WHERE a % 3 <> 1 UNION SELECT b, a FROM e WHERE a % 3 <> 1), c(x, y) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT x, b FROM c JOIN u ON y = a), k AS (SELECT x, min(y) AS root FROM c GROUP BY 1), n AS (SELECT root, count(*) AS n FROM k GROUP BY 1)
      SELECT sum(n)::BIGINT AS n_nodes, count(*) AS n_components, max(n) AS largest, round_even(1 - max(n) / sum(n), 4) AS ratio FROM n""",
    "graph_complexity": f"""WITH RECURSIVE {_PATHS}, d(node, k) AS (SELECT s_suppkey, 1::BIGINT FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM e) UNION SELECT b, k + 1 FROM d JOIN e ON node = a), i AS (SELECT node, max(k) AS hi, min(k) AS lo FROM d GROUP BY 1)
      SELECT (SELECT max(hi) FROM i) AS dependency_depth, (SELECT count(*) FROM e JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE x.s_nationkey <> y.s_nationkey) AS cross_app_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY b)) AS largest_fan_in,
        (SELECT count(*) FROM (SELECT a FROM e GROUP BY a HAVING count(*) >= 2)) AS branches, (SELECT min(lo) FROM i WHERE node % 6 = 5) AS irreversible_depth""",
    "semantic_horizon": f"""WITH RECURSIVE {_PATHS}, p AS (SELECT a, b, min(n) AS n FROM w GROUP BY 1, 2), s AS (SELECT s_suppkey AS root, s_suppkey * 7 % 10 AS shown FROM supplier)
      SELECT root, shown, CASE WHEN root = shown THEN 0 ELSE least(f.n, g.n) END AS horizon FROM s LEFT JOIN p f ON f.a = root AND f.b = shown LEFT JOIN p g ON g.a = shown AND g.b = root""",
}
