"""Queries over failed runs; events and orders stand in for changes, expected cells, typed texts and sightings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrail.operators import failures
from loomtrail.plans.tables import EV, indexed_events, table


def _tables(spark, d):
    e = indexed_events(spark, d).select(F.col("user_id").alias("run"), F.col("idx").alias("at"), F.col("event_id").alias("seq"), "event_type", F.lit("t").alias("table"), F.concat(F.lit("e"), F.floor(F.col("value") / 10).cast("string")).alias("entity"))
    op = F.when(F.col("event_type") == "purchase", "UPDATE").when(F.col("event_type") == "click", "INSERT").otherwise("DELETE")
    cells = F.when(F.col("event_type") == "error", F.create_map(F.lit("*"), F.lit(None).cast("string"))).otherwise(F.create_map(*(x for k, n in (("c", 3), ("d", 2), ("last_seen_at", 5)) for x in (F.lit(k), (F.col("seq") % n).cast("string")))))
    changes = e.where("event_type in ('purchase', 'click', 'error')").withColumn("op", op).select("run", "at", "seq", "op", "table", "entity", F.explode(cells).alias("column", "value"))
    last = e.where("event_type = 'signup'").groupBy("run", "table", "entity").agg(F.max("seq").alias("last"), F.min("seq").alias("ord"))
    expected = last.withColumn("old_value", F.when(F.col("ord") % 4 != 0, "1")).select("run", "table", "entity", "old_value", "ord", F.explode(F.create_map(F.lit("c"), (F.col("last") % 3).cast("string"), F.lit("d"), (F.col("last") % 2).cast("string"))).alias("column", "value"))
    return changes, expected, e.where("event_type = 'view'").select("run", "at", "table", "entity"), e.groupBy("run").agg(F.max("at").alias("last"))


def state_detector(spark, d):
    changes, expected, seen, _ = _tables(spark, d)
    return failures.state_candidates(changes, expected, seen)


def omission_detector(spark, d):
    changes, expected, seen, _ = _tables(spark, d)
    return failures.omission_candidates(changes, expected.groupBy("run", "table").agg(F.min("entity").alias("need")), seen)


def text_detector(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("run", F.col("o_custkey"))
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("on "), "day")).when(kind == 1, F.concat(F.lit("x"), F.expr("substr(o_orderpriority, 2)"))).when(kind == 2, F.col("o_orderpriority")).otherwise("ab")
    gold = o.where("o_orderkey % 3 = 0").select("run", F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.col("day")).otherwise(F.col("o_orderpriority")).alias("value"))
    return failures.text_candidates(o.select("run", "at", text.alias("text")), gold, o.where("o_orderkey % 8 <> 0").select("run", (F.col("at") - 1).alias("at"), F.col("day").alias("value")))


def _outcomes(last):
    return last.select("run", F.when(F.col("run") % 3 == 0, False).when(F.col("run") % 3 == 1, True).alias("final_verifier"), (F.col("run") % 2 == 0).alias("declared_complete"), (F.col("run") % 5 == 0).alias("budget_exhausted"))


def _candidates(spark, d):
    return state_detector(spark, d).drop("seq").unionByName(omission_detector(spark, d))


def failure_records(spark, d):
    return failures.records(_candidates(spark, d), _outcomes(_tables(spark, d)[3]))


def failure_horizon(spark, d):
    _, _, seen, last = _tables(spark, d)
    return failures.horizon(failures.root_causes(_candidates(spark, d)), last, seen)


QUERIES = {f.__name__: f for f in (state_detector, omission_detector, text_detector, failure_records, failure_horizon)}

_BASE = f"""{EV}, e AS (SELECT user_id AS run, idx AS "at", event_id AS seq, event_type, 'e' || floor(value / 10)::BIGINT AS entity FROM ev),
  ch AS (SELECT run, "at", seq, op, entity, unnest(ks) AS k, unnest(vs) AS value FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'UPDATE' WHEN 'click' THEN 'INSERT' ELSE 'DELETE' END AS op, CASE WHEN event_type = 'error' THEN ['*'] ELSE ['c', 'd', 'last_seen_at'] END AS ks,
      CASE WHEN event_type = 'error' THEN [NULL::VARCHAR] ELSE [(seq % 3)::VARCHAR, (seq % 2)::VARCHAR, (seq % 5)::VARCHAR] END AS vs FROM e WHERE event_type IN ('purchase', 'click', 'error'))),
  g AS (SELECT run, entity, ord, CASE WHEN ord % 4 <> 0 THEN '1' END AS old, unnest(['c', 'd']) AS k, unnest([(lst % 3)::VARCHAR, (lst % 2)::VARCHAR]) AS value FROM (SELECT run, entity, max(seq) AS lst, min(seq) AS ord FROM e WHERE event_type = 'signup' GROUP BY 1, 2)),
  own AS (SELECT ch.run, "at", seq, CASE WHEN ch.value <> g.value THEN 'wrong_value_written' WHEN sum((ch.value = g.value)::INT) OVER (PARTITION BY ch.run, ch.entity, ch.k ORDER BY "at", seq) > 1 THEN 'duplicate_gold_write' END AS pattern, 't.' || ch.entity || '.' || ch.k AS evidence FROM ch JOIN g ON g.run = ch.run AND g.entity = ch.entity AND g.k = ch.k),
  en AS (SELECT run, entity, min(ord) AS ord, bool_and(old IS NULL) AS ins FROM g GROUP BY 1, 2), st AS (SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.run = ch.run AND en.entity = ch.entity)),
  df AS (SELECT DISTINCT s.run, s.seq, w.entity FROM st s JOIN g w ON w.run = s.run AND w.k = s.k AND w.value IS DISTINCT FROM s.value),
  ft AS (SELECT r.run, r."at", r.seq, arg_min(t.entity, t.ord) AS template FROM (SELECT DISTINCT run, "at", seq FROM st) r JOIN en t ON t.run = r.run AND t.ins WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.run = r.run AND df.seq = r.seq AND df.entity = t.entity) GROUP BY 1, 2, 3),
  ag AS (SELECT run, "at", seq, 'duplicate_gold_write' AS pattern, 't.' || template AS evidence FROM ft QUALIFY row_number() OVER (PARTITION BY run, template ORDER BY "at", seq) > 1),
  lf AS (SELECT * FROM st WHERE k <> 'last_seen_at' AND NOT EXISTS (SELECT 1 FROM ft WHERE ft.run = st.run AND ft.seq = st.seq)),
  bv AS (SELECT run, k, value, arg_min(entity, ord) AS x FROM g GROUP BY 1, 2, 3), bc AS (SELECT run, k, arg_min(entity, ord) AS x FROM g WHERE old IS NOT NULL GROUP BY 1, 2),
  ht AS (SELECT lf.*, coalesce(bv.x, CASE WHEN op = 'UPDATE' THEN bc.x END) AS meant FROM lf LEFT JOIN bv ON bv.run = lf.run AND bv.k = lf.k AND bv.value = lf.value LEFT JOIN bc ON bc.run = lf.run AND bc.k = lf.k),
  rw AS (SELECT run, "at", seq, entity, min(k) FILTER (meant IS NOT NULL) AS k, arg_min(meant, k) FILTER (meant IS NOT NULL) AS meant FROM ht GROUP BY 1, 2, 3, 4), fs AS (SELECT run, entity, min("at") AS seen FROM e WHERE event_type = 'view' GROUP BY 1, 2),
  ot AS (SELECT rw.run, "at", seq, CASE WHEN meant IS NULL THEN 'extra_write' WHEN coalesce(a.seen < "at" AND b.seen < "at", false) THEN 'wrong_entity_co_displayed' ELSE 'wrong_entity' END AS pattern, concat_ws('.', 't', rw.entity, k) AS evidence
    FROM rw LEFT JOIN fs a ON a.run = rw.run AND a.entity = rw.entity LEFT JOIN fs b ON b.run = rw.run AND b.entity = meant),
  t AS (SELECT * FROM own WHERE pattern IS NOT NULL UNION ALL SELECT * FROM ag UNION ALL SELECT * FROM ot),
  o AS (SELECT DISTINCT ch.run, "at", 'required_read_never_observed' AS pattern, need AS evidence FROM ch JOIN (SELECT run, min(entity) AS need FROM g GROUP BY 1) n ON n.run = ch.run LEFT JOIN fs ON fs.run = ch.run AND fs.entity = need WHERE seen IS NULL OR seen > "at"),
  u(pattern, place, sure) AS (VALUES ('duplicate_gold_write', 0, 0.8), ('wrong_value_written', 0, 0.85), ('wrong_entity_co_displayed', 0, 0.9), ('wrong_entity', 0, 0.9), ('extra_write', 0, 0.6), ('required_read_never_observed', 2, 0.5)),
  z AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY "at", place, -sure, pattern, evidence) AS nth FROM (SELECT run, "at", pattern, evidence FROM t UNION ALL SELECT * FROM o) JOIN u USING (pattern) WHERE sure >= 0.7),
  rc AS (SELECT * FROM z WHERE nth = 1)"""

ORACLE = {
    "state_detector": f"WITH {_BASE} SELECT * FROM t",
    "omission_detector": f"WITH {_BASE} SELECT * FROM o",
    "text_detector": r"""WITH b AS (SELECT *, o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT - 1 AS "at", strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
      p AS (SELECT run, "at", CASE o_orderkey % 4 WHEN 0 THEN 'on ' || day WHEN 1 THEN 'x' || substr(o_orderpriority, 2) WHEN 2 THEN o_orderpriority ELSE 'ab' END AS text FROM b),
      g AS (SELECT run, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN day ELSE o_orderpriority END AS value FROM b WHERE o_orderkey % 3 = 0),
      q AS (SELECT * FROM p WHERE length(text) >= 3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.run = p.run AND g.value = p.text)),
      ty AS (SELECT run, "at", text, 'transcription_error' AS pattern, arg_min(value, dd * 1000000000000 + ord) AS evidence FROM (SELECT q.*, value, ord, levenshtein(lower(text), lower(value)) AS dd FROM q JOIN g USING (run) WHERE length(value) >= 4) WHERE dd <= 2 GROUP BY 1, 2, 3),
      dy AS (SELECT run, ord, value AS day FROM g WHERE regexp_matches(value, '^\d{4}-\d{2}-\d{2}$')), f AS (SELECT run, arg_min(day, ord) AS evidence FROM dy GROUP BY 1),
      s AS (SELECT run, day, min("at" - 1) AS seen FROM b WHERE o_orderkey % 8 <> 0 GROUP BY 1, 2),
      w AS (SELECT *, regexp_extract(text, '\d{4}-\d{2}-\d{2}') AS day FROM q WHERE NOT EXISTS (SELECT 1 FROM ty WHERE ty.run = q.run AND ty."at" = q."at"))
      SELECT * FROM ty UNION ALL SELECT w.run, "at", text, CASE WHEN coalesce(seen < "at", false) THEN 'stale_value_from_earlier_page' ELSE 'hallucinated_value' END, evidence FROM w JOIN f ON f.run = w.run LEFT JOIN s ON s.run = w.run AND s.day = w.day
      WHERE w.day <> '' AND NOT EXISTS (SELECT 1 FROM dy WHERE dy.run = w.run AND dy.day = w.day)""",
    "failure_records": f"""WITH {_BASE}, y AS (SELECT DISTINCT run, run % 2 = 0 AS declared, run % 5 = 0 AS spent FROM e WHERE run % 3 = 0),
      x AS (SELECT y.run, "at", coalesce(pattern, CASE WHEN spent THEN 'budget_exhausted_no_root_cause' WHEN declared THEN 'premature_completion_claim' END) AS pattern, evidence, n FROM y LEFT JOIN rc ON rc.run = y.run),
      v(pattern, type, category, "group", confidence) AS (VALUES ('wrong_entity_co_displayed', 'misunderstand_task_objective', 'planning', 'long_horizon', 0.85), ('wrong_entity', 'incorrect_ui_element', 'execution', 'local', 0.7), ('duplicate_gold_write', 'progress_misperception', 'perception', 'long_horizon', 0.8),
        ('wrong_value_written', 'typing_or_parameter_error', 'execution', 'local', 0.75), ('budget_exhausted_no_root_cause', 'budget_exhaustion', 'termination', 'termination', 0.95), ('premature_completion_claim', 'premature_completion', 'termination', 'termination', 0.95))
      SELECT run, "at", x.pattern, evidence, type, category, "group", coalesce(confidence, 0)::DOUBLE AS confidence, coalesce(n, 0) AS n_candidates FROM x LEFT JOIN v ON v.pattern = x.pattern""",
    "failure_horizon": f"""WITH {_BASE}, r AS (SELECT run, "at", split_part(evidence, '.', 2) AS entity FROM rc), l AS (SELECT run, max("at") AS last FROM e GROUP BY 1),
      i AS (SELECT r.run, min(e."at") AS identifiable FROM r JOIN e ON e.run = r.run AND e.entity = r.entity AND e.event_type = 'view' AND e."at" > r."at" GROUP BY 1)
      SELECT r.run, r."at", identifiable, coalesce(identifiable, last) - r."at" AS horizon, identifiable IS NULL AS censored FROM r JOIN l USING (run) LEFT JOIN i USING (run)""",
}
