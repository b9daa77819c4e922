"""Queries that make training records from runs of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import hints, samples
from loomtrail.plans.tables import EV, indexed_events, table

OFFSETS, DEPTHS = [0, 3, 9], [0, 5, 10, 15, 20, 25]
#: Parts of the records, as SQL that Spark and DuckDB both read.
_ITEM, _TEXT = "concat('item-', event_id % 37)", "concat('Open ITEM-', event_id * 7 % 37, ' now')"
_DAY = "concat('2024-01-', event_id % 18 + 10)"


def _tables(spark, d):
    e = indexed_events(spark, d).withColumn("run", F.col("user_id")).withColumn("at", F.col("idx"))
    steps = e.selectExpr("run", "at", "concat('t', event_id) AS thought", "event_type AS action", "event_type AS kind")
    params = e.where("event_id % 3 = 0").selectExpr("run", "at", "0 AS place", "'text' AS name", f"{_TEXT} AS value").union(e.where("event_id % 4 = 1").selectExpr("run", "at", "1", "'day'", f"concat('on ', {_DAY})")).union(e.where("event_id % 8 = 3").selectExpr("run", "at", "2", "'name'", f"{_ITEM}"))
    facts = e.where("event_id % 2 = 0").selectExpr("run", "at", "0 AS place", "CAST(NULL AS STRING) AS source", "concat('shop.', event_type) AS table", "'name' AS column", "concat('e', event_id % 11) AS entity", f"{_ITEM} AS value")
    facts = facts.union(e.where("event_id % 5 = 0").selectExpr("run", "at", "1", "'api'", "concat('shop.', event_type)", "'day'", "concat('e', event_id % 11)", f"concat({_DAY}, 'T10:00')"))
    deltas = e.where("event_id % 6 = 0").selectExpr("run", "at", "event_id AS seq", "'shop' AS db", "event_type AS tbl", "event_id % 50 AS rowid", "'UPDATE' AS op")
    gold = e.where("event_id % 25 = 0").selectExpr("run", "concat('shop.', event_type) AS table", "'name' AS column", "concat('e', event_id % 11) AS entity")
    n = e.groupBy("run").agg(F.count("*").alias("n"))
    analysis = n.selectExpr("run", "n div 4 AS root", "CASE WHEN run % 9 <> 4 THEN n div 2 END AS evidence", "concat('item-', run % 37) AS wrong_value", "CASE WHEN run % 2 = 0 THEN '2024-01-15T10:00' END AS gold_value", "concat('e', run % 11) AS gold_entity", "concat('e', (run + 3) % 11) AS wrong_entity", "run % 3 <> 0 AS censored")
    return steps, params, facts, deltas, gold, analysis


def _text(c):
    """A list of structs as one text."""
    return F.array_join(F.transform(c, lambda s: F.to_json(s)), ";")


def value_ledger(spark, d):
    _, params, facts, _, gold, _ = _tables(spark, d)
    return samples.ledger(facts, params, gold, 6)


def detection_records(spark, d):
    steps, params, facts, deltas, gold, analysis = _tables(spark, d)
    out = samples.detection_samples(steps, analysis, samples.ledger(facts, params, gold, 6), facts, params, deltas, OFFSETS)
    return out.select("sample_id", "thought", F.size("history").alias("n_history"), F.get("history", F.size("history") - 1)["thought"].alias("last_thought"), F.array_join(F.transform("entries", lambda x: F.concat_ws("=", x["name"], x["value"])), ",").alias("entries"))


def recovery_records(spark, d):
    steps, params, facts, deltas, gold, analysis = _tables(spark, d)
    split = steps.select("run").distinct().withColumn("split", F.when(F.col("run") % 5 == 0, "test").otherwise("train"))
    out = samples.recovery_cases(steps, analysis, samples.ledger(facts, params, gold, 6), facts, params, deltas, split, DEPTHS)
    return out.select("sample_id", "cut", F.size("history").alias("n_history"), F.col("contradiction.value").alias("shown"), F.col("carried.name").alias("carried"), F.col("affected.seq").alias("written"), "verified")


def verification_cuts(spark, d):
    steps, _, _, deltas, _, analysis = _tables(spark, d)
    guarded = steps.select("run", F.concat(F.lit("shop."), "kind").alias("table")).where("kind = 'purchase' or run % 4 = 1")
    return samples.verification_samples(steps, analysis, deltas, steps.where("run % 7 <> 2").select("run"), guarded)


def gold_action_records(spark, d):
    """Orders as runs: their lines are nodes, of which the third one is the root."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("node")).agg(F.min("l_linenumber").alias("place"), F.min("l_returnflag").alias("app"), F.min("l_linestatus").alias("op"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"))
    analysis = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 10 < 9, "3").alias("node"), F.element_at(F.array(*map(F.lit, ["parameter", "omission", "state", "other"])), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("detector"))
    values = line.select("run", "node", F.lit("part").alias("name"), F.col("part").alias("value")).union(line.select("run", "node", F.lit("supplier"), "supplier"))
    writes = line.where("part % 2 = 0").select("run", "node", "place", F.lit("t").alias("table"), F.col("supplier").alias("value"))
    out = samples.gold_actions(analysis.join(line.select("run", "node"), ["run", "node"], "left_semi"), line.select("run", "node", "place", "app", "op"), values, writes)
    return out.select("run", "node", "kind", "app", "op", F.to_json("parameters").alias("parameters"), F.get("gold_writes", F.lit(0))["value"].alias("first_write"), F.array_join("continue_with", ",").alias("continue_with"))


def _attempts(spark, d, policy):
    """Lines of an order as attempts, by return flag as level."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("level"), F.when(F.col("l_linestatus") == "F", "self").otherwise("external").alias("teacher"), F.col("l_linenumber").alias("attempt")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    return samples.accepted_attempts(a.select("case", "level", "teacher", "attempt", (F.col("s") % 3 == 0).alias("verified"), (F.col("p") % 2 == 0).alias("leaked")), ["N", "R", "A"], policy)


def accepted_attempts(spark, d):
    out = _attempts(spark, d, "off").withColumn("policy", F.lit("off"))
    for policy in ("resample", "drop"):
        out = out.union(_attempts(spark, d, policy).withColumn("policy", F.lit(policy)))
    return out


def _hinted(spark, d):
    steps, params, facts, deltas, gold, analysis = _tables(spark, d)
    split = steps.select("run").distinct().withColumn("split", F.lit("train"))
    out = samples.recovery_cases(steps, analysis, samples.ledger(facts, params, gold, 6), facts, params, deltas, split, [0]).where("verified")
    return out.join(analysis.select("run", "root"), "run").select("run", "root", hints.state_hint().alias("hint"), F.col("affected.tbl").alias("tbl"), F.col("carried.value").alias("used"))


def hint_texts(spark, d):
    return _hinted(spark, d).select("run", "hint")


def hint_leaks(spark, d):
    """Thoughts that say the step, the table, or the hint's own words, against instructions that hold some of them."""
    h = _hinted(spark, d)
    said = F.concat(F.when(F.col("run") % 2 == 0, F.concat(F.lit("I redo step #"), "root", F.lit(". "))).otherwise("Hm. "), F.when(F.col("run") % 3 == 0, F.concat(F.lit("the "), F.coalesce("tbl", F.lit("none")), F.lit(" row. "))).otherwise(""), F.when(F.col("run") % 5 < 2, F.concat(F.lit("But You used '"), "used", F.lit("' from there, a HINT"))).otherwise("fine"))
    context = F.when(F.col("run") % 7 == 0, F.concat(F.lit("but you used "), "used", F.lit(" from "), F.coalesce("tbl", F.lit("")))).otherwise("go")
    found = hints.leaks(F.col("hint"), F.when(F.col("run") % 11 != 3, said), context, F.col("root"), F.col("tbl"), 5, [r"\bhint\b"])
    return h.select("run", F.array_join(found, ";").alias("leaks"))


def annotation_export(spark, d):
    """Orders as runs, lines as criteria, return flags as annotators."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("criterion")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    criteria = line.select("run", "criterion", F.when(F.col("s") % 6 == 1, -1.0).when(F.col("s") % 6 == 2, F.lit(None)).otherwise((F.col("s") % 6).cast("double")).alias("weight"))
    scored = line.where("not (run % 9 = 4 and criterion = '1')").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("criterion", (F.col("p") % 4 != 0).cast("int").alias("v")))).alias("scores"))
    who = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("annotator")).distinct()
    reviews = who.join(scored, "run").select("run", "annotator", F.when(F.col("run") % 13 != 6, F.col("scores")).alias("scores"), F.concat(F.lit("s"), "run").alias("sha"))
    flags = who.where("annotator = 'R' and run % 4 = 1").select("run", "annotator", F.lit("needs_rerun").alias("status"), F.concat(F.lit("s"), "run").alias("sha")).union(who.where("annotator = 'N'").select("run", "annotator", F.lit("ok"), F.lit("x")))
    out = hints.annotation_export(reviews, flags, criteria, who.where("run % 3 = 0").select("run", "annotator", F.lit("late").alias("failure")))
    return out.withColumn("score", F.round("score", 9))


QUERIES = {f.__name__: f for f in (hint_texts, hint_leaks, annotation_export, value_ledger, detection_records, recovery_records, verification_cuts, gold_action_records, accepted_attempts)}

_BASE = f"""{EV}, e AS (SELECT *, user_id AS run, idx AS k FROM ev),
  p AS (SELECT run, k, 0 AS place, 'text' AS name, {_TEXT} AS value FROM e WHERE event_id % 3 = 0 UNION ALL SELECT run, k, 1, 'day', concat('on ', {_DAY}) FROM e WHERE event_id % 4 = 1 UNION ALL SELECT run, k, 2, 'name', {_ITEM} FROM e WHERE event_id % 8 = 3),
  f AS (SELECT run, k, 0 AS place, 'gui' AS src, 'shop.' || event_type AS t, 'name' AS c, 'e' || event_id % 11 AS n, {_ITEM} AS value, {_ITEM} AS look FROM e WHERE event_id % 2 = 0
    UNION ALL SELECT run, k, 1, 'api', 'shop.' || event_type, 'day', 'e' || event_id % 11, concat({_DAY}, 'T10:00'), {_DAY} FROM e WHERE event_id % 5 = 0),
  w AS (SELECT run, k, event_id AS seq, event_type AS tbl, event_id % 50 AS rowid FROM e WHERE event_id % 6 = 0),
  g AS (SELECT DISTINCT run, 'shop.' || event_type AS t, 'e' || event_id % 11 AS n FROM e WHERE event_id % 25 = 0),
  z AS (SELECT run, count(*) AS n, max(k) AS last, count(*) // 4 AS root, CASE WHEN run % 9 <> 4 THEN count(*) // 2 END AS evidence, concat('item-', run % 37) AS wrong, CASE WHEN run % 2 = 0 THEN '2024-01-15T10:00' END AS gv, 'e' || run % 11 AS ge, 'e' || (run + 3) % 11 AS we FROM e GROUP BY run),
  q AS (SELECT f.* FROM f WHERE length(value) >= 6 AND (c = 'name' AND EXISTS (SELECT 1 FROM g WHERE g.run = f.run AND g.t = f.t AND g.n = f.n) OR EXISTS (SELECT 1 FROM p WHERE p.run = f.run AND p.k > f.k AND contains(lower(p.value), lower(look))))),
  l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY run, t, c, n ORDER BY k, place) = 1)"""
# of a cut what was shown, what was carried and what was written
_EVIDENCE = """s AS (SELECT z.run, arg_min(value, place) AS shown, arg_min(c, place) AS shown_column FROM z JOIN f ON f.run = z.run AND f.k = z.evidence WHERE f.n IN (ge, we) OR contains(gv, left(value, 10)) GROUP BY z.run),
  c AS (SELECT x.run, x.cut, arg_max(t || '.' || l.c || '@' || l.n, (l.k, l.place)) AS name, arg_max(l.k, (l.k, l.place)) AS k FROM x JOIN z USING (run) JOIN l ON l.run = x.run AND l.k <= x.known_to AND l.value = z.wrong GROUP BY 1, 2),
  r AS (SELECT z.run, arg_max('param:' || name, place) AS name, max(p.k) AS k FROM z JOIN p ON p.run = z.run AND p.k = z.root AND p.value = z.wrong GROUP BY 1),
  a AS (SELECT z.run, arg_min(w.k, seq) AS k, min(seq) AS seq, arg_min(tbl, seq) AS tbl, arg_min(rowid, seq) AS rowid FROM z JOIN w ON w.run = z.run AND w.k >= z.root GROUP BY 1),
  y AS (SELECT x.*, shown, shown_column, wrong, coalesce(c.name, r.name) AS carried, coalesce(c.k, r.k) AS carried_at, CASE WHEN a.k <= x.cut THEN a.seq END AS written, CASE WHEN a.k <= x.cut THEN '; step ' || a.k || ' already wrote shop.' || a.tbl || ':' || a.rowid ELSE '' END AS wrote
    FROM x JOIN z USING (run) LEFT JOIN s USING (run) LEFT JOIN c ON c.run = x.run AND c.cut = x.cut LEFT JOIN r ON r.run = x.run LEFT JOIN a ON a.run = x.run)"""


def _attempts_sql(policy: str, good: str, keep: str = "true") -> str:
    return f"""SELECT "case", level, teacher, attempt, n AS n_attempts, '{policy}' AS policy FROM (SELECT * FROM n WHERE {good} QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY n) = 1) WHERE {keep}"""


_HINTS = f"""{_BASE}, x AS (SELECT run, root AS cut, root AS known_to FROM z WHERE root <= last), {_EVIDENCE},
  h AS (SELECT y.run, y.cut AS root, CASE WHEN a.k <= y.cut THEN a.tbl END AS tbl, wrong AS used, 'Step ' || y.cut || ' was wrong: the screen shows ' || shown_column || ' = ''' || shown || ''', but you used ''' || wrong || ''' (from step ' || carried_at || ').' ||
    CASE WHEN a.k <= y.cut THEN ' Step ' || a.k || ' already changed shop.' || a.tbl || ' (row ' || a.rowid || '): compensate that first, then redo the step correctly.' ELSE ' Nothing has been written yet: redo the step correctly.' END AS hint
    FROM y LEFT JOIN a USING (run) WHERE shown IS NOT NULL AND carried IS NOT NULL)"""
ORACLE = {
    "hint_texts": f"WITH {_HINTS} SELECT run, hint FROM h",
    "hint_leaks": f"""WITH {_HINTS}, k AS (SELECT *, replace(used, '-', ' ') AS u FROM h)
      SELECT run, CASE WHEN run % 11 = 3 THEN '' ELSE concat_ws(';', CASE WHEN run % 2 = 0 THEN 'step:' || root END, CASE WHEN run % 3 = 0 AND run % 7 <> 0 THEN 'table:' || tbl END,
        CASE WHEN run % 5 < 2 AND run % 7 <> 0 THEN 'ngram:but you used ' || u || ';ngram:you used ' || u || ' from' END, CASE WHEN run % 5 < 2 THEN 'pattern:' || chr(92) || 'bhint' || chr(92) || 'b' END) END AS leaks FROM k""",
    "annotation_export": """WITH l AS (SELECT l_orderkey AS run, l_linenumber::VARCHAR AS c, min(l_suppkey) % 6 AS s, (min(l_partkey) % 4 <> 0)::INT AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT *, CASE WHEN s IN (0, 1, 2) THEN 1 ELSE s END AS weight FROM l),
      g AS (SELECT run, sum(weight * v) / sum(weight) AS score, min(v) AS solved, bool_or(c = '1') AND run % 9 = 4 AS short, count(*) AS n FROM w GROUP BY run), a AS (SELECT DISTINCT l_orderkey AS run, l_returnflag AS annotator FROM lineitem),
      r AS (SELECT annotator, g.*, annotator = 'R' AND run % 4 = 1 AS again, CASE WHEN run % 13 = 6 THEN 'no scores' WHEN short THEN 'scores of other criteria' END AS fault FROM a JOIN g USING (run))
      SELECT run, annotator, 's' || run AS sha, CASE WHEN NOT again AND fault IS NULL THEN round(score, 9) END AS score, CASE WHEN NOT again AND fault IS NULL THEN solved END AS solved, CASE WHEN NOT again AND run % 3 = 0 THEN 'late' END AS failure,
        CASE WHEN again THEN 'needs_rerun' ELSE 'valid' END AS status, CASE WHEN NOT again THEN fault END AS fault FROM r WHERE again OR NOT (short AND n = 1)""",
    "value_ledger": f"""WITH {_BASE} SELECT run, k AS "at", place, t || '.' || c || '@' || n AS name, value, 'obs:' || k || ':' || src AS source_ref FROM l""",
    "detection_records": f"""WITH {_BASE}, x AS (SELECT run, evidence + o AS cut, evidence + o - 1 AS known_to FROM z, (SELECT unnest({OFFSETS}) AS o) WHERE evidence + o <= last), {_EVIDENCE}
      SELECT run || '_detection_' || cut AS sample_id, 'The current observation shows ' || shown_column || ' = ''' || shown || ''', but I carried ''' || wrong || ''' (from step ' || carried_at || ')' || wrote || '.' AS thought, cut::INTEGER AS n_history,
        (SELECT 't' || event_id FROM e WHERE e.run = y.run AND e.k = y.cut - 1) AS last_thought, coalesce((SELECT string_agg(t || '.' || l.c || '@' || l.n || '=' || value, ',' ORDER BY l.k, l.place) FROM l WHERE l.run = y.run AND l.k <= known_to), '') AS entries
      FROM y WHERE shown IS NOT NULL AND carried IS NOT NULL""",
    "recovery_records": f"""WITH {_BASE}, x AS (SELECT run, root + o AS cut, root + o AS known_to, o AS depth FROM z, (SELECT unnest({DEPTHS}) AS o) WHERE root + o <= last AND run % 5 <> 0), {_EVIDENCE}
      SELECT run || '_d' || depth AS sample_id, cut, (cut + 1)::INTEGER AS n_history, shown, carried, written, shown IS NOT NULL AND carried IS NOT NULL AS verified FROM y""",
    "verification_cuts": f"""WITH {_BASE}, h AS (SELECT DISTINCT run, event_type AS tbl FROM e WHERE event_type = 'purchase' OR run % 4 = 1)
      SELECT run || '_verification_' || min(w.k) AS sample_id, run, min(w.k) AS cut, 'About to perform an irreversible action; the value it uses came from step ' || root || ' and has not been re-checked since.' AS thought
      FROM z JOIN w USING (run) JOIN h USING (run, tbl) WHERE run % 3 <> 0 AND run % 7 <> 2 AND w.k > root GROUP BY run, root""",
    "gold_action_records": """WITH l AS (SELECT l_orderkey AS run, l_linenumber AS n, min(l_returnflag) AS app, min(l_linestatus) AS op, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
      SELECT run, '3' AS node, CASE run % 4 WHEN 1 THEN 'execute_skipped_node' WHEN 2 THEN 'compensate_writes_then_redo_node' ELSE 'redo_node_with_gold_values' END AS kind, app, op, '{"part":' || p || ',"supplier":' || s || '}' AS parameters,
        CASE WHEN p % 2 = 0 THEN s END AS first_write, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM l x WHERE x.run = l.run AND x.n > 3), '') AS continue_with FROM l JOIN orders ON o_orderkey = run WHERE n = 3 AND run % 10 < 9""",
    "accepted_attempts": f"""WITH a AS (SELECT l_orderkey AS "case", l_returnflag AS level, CASE WHEN l_linestatus = 'F' THEN 'self' ELSE 'external' END AS teacher, l_linenumber AS attempt, min(l_suppkey) % 3 = 0 AS v, min(l_partkey) % 2 = 0 AS leaked FROM lineitem GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY teacher <> 'self', CASE level WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, attempt)::INTEGER AS n FROM a)
      {_attempts_sql('off', 'v')} UNION ALL {_attempts_sql('resample', 'v AND NOT leaked')} UNION ALL {_attempts_sql('drop', 'v', 'NOT leaked')}""",
}
