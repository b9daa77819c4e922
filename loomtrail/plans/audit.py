"""Queries over stored records and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import audits, texts
from loomtrail.plans.documents import _EDGES, _edges
from loomtrail.plans.tables import table

REQUIRED = ["click", "view", "purchase"]
BUCKETS = ["1", "2-3", ">=4", "verifier_only"]


def fresh_verdicts(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("task"), "text", "turn", "role")
    v = c.select("task", F.when(F.col("turn") % 3 == 0, "b").otherwise("a").alias("model"), F.sha2(F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"), F.col("role").alias("verdict"))
    return audits.fresh_verdicts(c, v, "a")


def judge_coverage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 3 * 5).alias("depth"), F.col("o_orderstatus").alias("condition"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("model"))
    return audits.judge_coverage(o, l, ["depth", "condition"], "unit")


def matched_results(spark, d):
    l = table(spark, d, "lineitem")
    return audits.matched_results(table(spark, d, "orders").select("o_orderkey"), l.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("content")), ["o_orderkey"])


def lines_in_turns(spark, d):
    n = table(spark, d, "nation")
    turns = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("turn"), (F.col("s_suppkey") % 4).cast("long").alias("calls"))
    lines = n.select(F.col("n_nationkey").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("line"))
    return audits.in_turn(lines, turns, "run")


def _marks(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("reviewer")).agg(F.min("l_linenumber").alias("proposal"))


def picked_proposals(spark, d):
    return audits.picked_proposals(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.lit("N").alias("annotator")), _marks(spark, d))


def repair_roots(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") * 2).alias("sha"))
    marks = _marks(spark, d).select("run", (F.col("run") * 2 + (F.col("reviewer") == "A").cast("int")).alias("sha"), F.col("proposal").alias("root"))
    return audits.repair_roots(marks, marks.where("run % 5 = 0"), runs)


def single_matches(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("digest"))
    return audits.single_matches(table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("digest")), s.select("digest", F.concat(F.lit("f"), "s_suppkey").alias("path")), "n_name", "digest")


def over_budget(spark, d):
    return audits.over_budget(table(spark, d, "documents").select("source", "lang", F.ceil(F.col("n_chars") / 4).alias("tokens")), ["source", "lang"], "tokens", 900)


def time_probes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    cells = table(spark, d, "orders").where("o_orderkey % 6 <> 1").select("o_orderkey", F.date_format(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate")), "yyyy-MM-dd'T'HH:mm").alias("value"))
    return audits.time_probes(o, cells, ["o_orderkey"])


def several_builds(spark, d):
    return audits.several_builds(table(spark, d, "lineitem"), "l_partkey", "l_linestatus")


def task_problems(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), "o_orderkey", "o_orderstatus")
    return audits.problems(o.where("o_orderkey % 7 = 0").select("task", F.lit("static").alias("kind"), F.col("o_orderkey").cast("string").alias("text")), o.where("o_orderkey % 5 = 0").select("task", F.lit("ground").alias("kind"), F.col("o_orderstatus").alias("text")))


def steady_images(spark, d):
    c = table(spark, d, "customer")
    image = F.create_map(F.lit("name"), F.col("c_name"), F.lit("updated_at"), F.lit("x"), F.lit("last_login_time"), F.lit("y"), F.lit("seg"), F.col("c_mktsegment"))
    return c.select("c_custkey", F.to_json(audits.steady_image(image, "a.t")).alias("image"))


def resolved_names(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("app"), "n_regionkey").alias("app"))
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" Nation_"), F.col("s_suppkey") * 3).alias("name"))
    return audits.resolved_names(s, "name", a)


def reframed_points(spark, d):
    x, y = (F.col("event_id") * k % n for k, n in ((37, 1400), (53, 900)))
    e = table(spark, d, "events").select("event_id", x.alias("x"), y.alias("y"))
    a, b = audits.clamped(F.col("x"), F.col("y"), F.lit(1280), F.lit(800), F.lit(1920), F.lit(1080))
    return e.select("event_id", a.alias("x"), b.alias("y"))


def release_gate(spark, d):
    e = table(spark, d, "events")
    return audits.gate(e.select("user_id", F.col("event_type").alias("name"), (F.col("value") > 3).alias("passed")), "user_id", REQUIRED)


def contract_breaches(spark, d):
    rules = {"price": F.col("o_totalprice") > 20_000, "status": F.col("o_orderstatus").isin("F", "O"), "known": F.when(F.col("o_orderkey") % 10 != 3, F.lit(True))}
    return audits.contract_breaches(table(spark, d, "orders"), "o_orderkey", rules)


def _horizons(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("position"), (F.col("s_nationkey") % 3).alias("app"))
    facts = s.withColumns({"table": F.lit("t"), "column": (F.col("node") % 2).cast("string")})
    reads = facts.where("node % 3 <> 1").select("node", "table", "column", F.when(F.col("node") % 8 == 5, "e:*").otherwise(F.concat(F.lit("e:"), F.col("node") % 4)).alias("entity"))
    writes = facts.where("node % 2 = 0").select("node", "table", F.lit("1").alias("column"), F.concat(F.lit("e:"), F.col("node") % 5).alias("entity"))
    return audits.latent_horizons(s, _edges(spark, d).toDF("source", "target"), reads, writes, s.where("node % 7 = 6"))


def latent_horizons(spark, d):
    return _horizons(spark, d)


def horizon_profile(spark, d):
    return audits.profile(_horizons(spark, d), "app", BUCKETS, ["2-3", ">=4"])


def reasoning_removed(spark, d):
    c = table(spark, d, "conversations")
    reply = F.concat(F.lit("<think>why\n"), F.col("role"), F.lit("</think> "), F.substring("text", 1, 20), F.lit(" <think>x</think>"))
    return c.select("conv_id", "turn", texts.without_marked(reply, "<think>", "</think>").alias("reply"))


def fenced_verdicts(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(F.lit('{"v": "'), F.col("role"), F.lit('"}'))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\nend {}"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is "), body, F.lit("."))).otherwise(F.lit("none"))
    return c.select("conv_id", "turn", F.get_json_object(F.nullif(texts.fenced_json(reply), F.lit("")), "$.v").alias("verdict"))


QUERIES = {f.__name__: f for f in (fresh_verdicts, judge_coverage, matched_results, lines_in_turns, picked_proposals, repair_roots, single_matches, over_budget, time_probes, several_builds, task_problems, steady_images, resolved_names, reframed_points,
    release_gate, contract_breaches, latent_horizons, horizon_profile, reasoning_removed, fenced_verdicts)}

_M = "m AS (SELECT l_orderkey AS run, l_returnflag AS reviewer, min(l_linenumber) AS proposal FROM lineitem GROUP BY 1, 2)"
_H = f"""{_EDGES}, w(a, b, n) AS (SELECT a, b, 1::BIGINT FROM e UNION SELECT w.a, e.b, n + 1 FROM w JOIN e ON w.b = e.a), p AS (SELECT a, b, min(n) AS n FROM w GROUP BY 1, 2), s AS (SELECT s_suppkey AS node, s_nationkey % 3 AS app FROM supplier),
  rd AS (SELECT node, node % 2 AS c, CASE WHEN node % 8 = 5 THEN 'e:*' ELSE 'e:' || node % 4 END AS x FROM s WHERE node % 3 <> 1), wr AS (SELECT node, 1 AS c, 'e:' || node % 5 AS x FROM s WHERE node % 2 = 0), ln AS (SELECT a AS node, b AS other FROM p UNION SELECT node, node FROM s),
  dy AS (SELECT * FROM rd UNION SELECT ln.node, c, x FROM ln JOIN wr ON wr.node = other), mt AS (SELECT dy.node, min(rd.node) AS seen FROM dy JOIN rd ON rd.node > dy.node AND rd.c = dy.c AND (rd.x = dy.x OR rd.x = 'e:*' OR dy.x = 'e:*') GROUP BY 1),
  h AS (SELECT s.node, s.node AS position, s.app, seen AS visible, coalesce(p.n, seen - s.node) AS horizon, coalesce(t.app <> s.app, false) AS cross_app, s.node IN (SELECT node FROM ln WHERE other % 7 = 6) AS checked FROM s LEFT JOIN mt ON mt.node = s.node LEFT JOIN p ON p.a = s.node AND p.b = seen LEFT JOIN s t ON t.node = seen),
  z AS (SELECT node, position, app, visible, horizon, CASE WHEN horizon = 1 THEN 'required_next' WHEN horizon IS NOT NULL THEN 'required_later' WHEN checked THEN 'verifier_only' ELSE 'silent' END AS observability, cross_app FROM h)"""

ORACLE = {
    "fresh_verdicts": "SELECT conv_id || '/' || turn AS task, CASE WHEN turn % 3 <> 0 AND turn % 4 <> 1 THEN role END AS verdict FROM conversations",
    "judge_coverage": "WITH j AS (SELECT DISTINCT l_orderkey AS u, l_returnflag AS m FROM lineitem), x AS (SELECT o_orderkey % 3 * 5 AS depth, o_orderstatus AS condition, o_orderkey AS u, m FROM orders LEFT JOIN j ON u = o_orderkey) SELECT depth, condition, count(DISTINCT u) AS n, count(DISTINCT u) FILTER (m IS NOT NULL) AS n_judged, coalesce(string_agg(DISTINCT m, ',' ORDER BY m), '') AS models FROM x GROUP BY 1, 2",
    "matched_results": "WITH r AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS c FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n = 1 THEN c END AS content, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'matched' END AS state FROM orders LEFT JOIN r ON k = o_orderkey",
    "lines_in_turns": """WITH t AS (SELECT s_nationkey AS run, s_suppkey AS turn, s_suppkey % 4 AS calls, sum(s_suppkey % 4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS stop FROM supplier), l AS (SELECT n_nationkey AS run, unnest(range(10)) AS line FROM nation)
      SELECT l.run, line, turn FROM l LEFT JOIN t ON t.run = l.run AND line >= stop - calls AND line < stop""",
    "picked_proposals": f"WITH {_M}, n AS (SELECT run, CASE WHEN count(*) = 1 THEN min(proposal) END AS one FROM m GROUP BY 1) SELECT o_orderkey AS run, 'N' AS annotator, coalesce(m.proposal, one) AS proposal FROM orders LEFT JOIN m ON m.run = o_orderkey AND reviewer = 'N' LEFT JOIN n ON n.run = o_orderkey",
    "repair_roots": f"WITH {_M}, v AS (SELECT * FROM m WHERE reviewer <> 'A'), n AS (SELECT run, CASE WHEN run % 5 = 0 OR count(DISTINCT proposal) = 1 THEN min(proposal) END AS root FROM v GROUP BY 1) SELECT o_orderkey AS run, root FROM orders LEFT JOIN n ON run = o_orderkey",
    "single_matches": "SELECT n_name, CASE WHEN count(s_suppkey) = 1 THEN 'f' || min(s_suppkey) END AS path, CASE WHEN count(s_suppkey) = 0 THEN 'none' WHEN count(s_suppkey) > 1 THEN 'several' END AS fault FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "over_budget": "SELECT source, lang, max((n_chars + 3) // 4) AS largest, count(*) FILTER ((n_chars + 3) // 4 > 900) AS n_over, count(*) AS n, count(*) FILTER ((n_chars + 3) // 4 > 900) > 0 AS excluded FROM documents GROUP BY 1, 2",
    "time_probes": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CASE WHEN o_orderkey % 6 <> 1 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M') END AS found FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 1",
    "several_builds": "SELECT l_partkey, count(DISTINCT l_linestatus) AS n_builds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1",
    "task_problems": "WITH x AS (SELECT o_custkey AS task, 'static: ' || o_orderkey AS t FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_custkey, 'ground: ' || o_orderstatus FROM orders WHERE o_orderkey % 5 = 0) SELECT task, count(*) AS n, string_agg(t, '; ' ORDER BY t) AS problems FROM x GROUP BY 1",
    "steady_images": """SELECT c_custkey, '{"name":"' || c_name || '","seg":"' || c_mktsegment || '"}' AS image FROM customer""",
    "resolved_names": "SELECT s_suppkey, ' Nation_' || s_suppkey * 3 AS name, 'app' || n_regionkey AS app FROM supplier LEFT JOIN nation ON lower(n_name) = 'nation_' || s_suppkey * 3",
    "reframed_points": "SELECT event_id, least(greatest(round_even(event_id * 37 % 1400 * 1920 / 1280, 0)::BIGINT, 0), 1919) AS x, least(greatest(round_even(event_id * 53 % 900 * 1080 / 800, 0)::BIGINT, 0), 1079) AS y FROM events",
    "release_gate": f"""WITH g AS (SELECT user_id, event_type, bool_and(value > 3) AS ok FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2), u AS (SELECT user_id, r, i FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest({REQUIRED}) AS r, unnest([1, 2, 3]) AS i))
      SELECT u.user_id, bool_and(coalesce(ok, false)) AS released, coalesce(string_agg(r, ',' ORDER BY i) FILTER (NOT coalesce(ok, false)), '') AS open FROM u LEFT JOIN g ON g.user_id = u.user_id AND event_type = r GROUP BY 1""",
    "contract_breaches": "WITH x AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 20000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderkey % 10 = 3 THEN 'known' END) AS broken FROM orders) SELECT * FROM x WHERE broken <> ''",
    "latent_horizons": f"WITH RECURSIVE {_H} SELECT * FROM z",
    "horizon_profile": f"""WITH RECURSIVE {_H}, b AS (SELECT *, CASE WHEN horizon IS NULL THEN 'verifier_only' WHEN horizon = 1 THEN '1' WHEN horizon BETWEEN 2 AND 3 THEN '2-3' WHEN horizon >= 4 THEN '>=4' ELSE 'none' END AS bucket FROM z),
      c AS (SELECT app, bucket FROM (SELECT app, bucket, count(*) AS n FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY app ORDER BY n DESC, bucket DESC) = 1)
      SELECT b.app, count(*) AS n_nodes, count(*) FILTER (observability = 'required_next') AS required_next, count(*) FILTER (observability = 'required_later') AS required_later, count(*) FILTER (observability = 'verifier_only') AS verifier_only, count(*) FILTER (observability = 'silent') AS silent,
        count(*) FILTER (cross_app) AS cross_app, max(horizon) AS longest, median(horizon) AS median, round_even(count(*) FILTER (cross_app OR observability = 'verifier_only') / count(*), 4) AS hidden_share, count(*) FILTER (b.bucket IN ('2-3', '>=4')) AS in_target, c.bucket FROM b JOIN c USING (app) GROUP BY b.app, c.bucket""",
    "reasoning_removed": "SELECT conv_id, turn, trim(text[:20]) AS reply FROM conversations",
    "fenced_verdicts": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN role END AS verdict FROM conversations",
}
