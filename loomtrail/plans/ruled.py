"""Queries over rules given as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import rules
from loomtrail.plans.tables import table

COLUMNS = ["created_at", "start_at", "remind_at", "last_seen_time", "timestamp", "created_by_vm_id", "unread_count", "canonical_row_key", "title", "late_at"]
TABLES = ["calendar.events", "chat.reminders", "other.things"]
KEPT = {"calendar.events": ["start_at", "created_at"], "chat.reminders": ["remind_at", "timestamp"]}
FAMILIES = [("^eco", "low"), ("STAN|med", "mid"), ("promo", "high")]
BUCKETS = ["1", "2-3", ">=4", "verifier_only"]
LABELS = ["scope_error", "wrong_target", "exceed_bash_budget", "hallucinated_data", "ineffective_action", "premature_completion", "constraint_loss"]
RANKS = ["R0", "R1", "R2", "R3"]
GROUPS = {"Supplier 1": "a", "Nation-2": "a"}


def volatile_cells(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, TABLES)), F.col("n_nationkey") % 3).alias("table"), F.explode(F.array(*map(F.lit, COLUMNS))).alias("column"))
    return n.withColumn("volatile", rules.is_volatile(F.col("table"), F.col("column"), kept=KEPT))


def steady_columns(spark, d):
    c = table(spark, d, "customer").withColumnsRenamed({"c_acctbal": "updated_at", "c_mktsegment": "title"})
    return rules.steady(c, "app.customer")


def renamed_keys(spark, d):
    n = table(spark, d, "nation")
    entries = F.map_filter(F.create_map(F.lit("old"), F.col("n_name"), F.lit("older"), F.lit("z"), F.lit("new"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("kept")), F.lit("other"), F.lit("o")), lambda k, v: v.isNotNull())
    out = rules.renamed(entries, {"old": "new", "older": "other", "other": "name"})
    return n.select("n_nationkey", *(out[k].alias(k) for k in ("old", "older", "new", "other", "name")))


def type_families(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.first_match(F.col("p_type"), FAMILIES, "text").alias("family"))


def horizon_buckets(spark, d):
    h = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 6)
    return table(spark, d, "part").select("p_partkey", rules.horizon_bucket(h, BUCKETS).alias("bucket"))


def _labels(spark, d):
    pick = [F.get(F.array(*map(F.lit, LABELS)), ((F.col("p_partkey") * k + k) % len(LABELS)).cast("int")) for k in (1, 2, 3)]
    return table(spark, d, "part").withColumn("labels", rules.normal_labels(F.array(*pick)))


def normal_labels(spark, d):
    first = rules.primary_label(F.col("labels"))
    return _labels(spark, d).select("p_partkey", F.array_join("labels", ",").alias("labels"), first.alias("first"), rules.category_of(first).alias("category"), rules.group_of(first).alias("group"))


def judge_sources(spark, d):
    a, b = table(spark, d, "supplier"), table(spark, d, "nation")
    judge, agent = F.concat(F.lit("Supplier "), F.col("s_suppkey") % 12), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x/supplier-"), F.col("s_suppkey") % 5)).otherwise(F.replace("n_name", F.lit("_"), F.lit("-")))
    return a.join(b, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", rules.same_source(judge, agent, GROUPS).alias("same"))


def _classes(spark, d):
    kind = F.when(F.col("event_type") == "view", "R0").when(F.col("event_type") == "click", "R1").when(F.col("event_type") == "purchase", "R2").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "R3").otherwise("R0")
    return table(spark, d, "events").withColumn("class", kind)


def reversibility(spark, d):
    return rules.greatest_class(_classes(spark, d), "user_id", "class", RANKS)


def before_irreversible(spark, d):
    return rules.before_first(_classes(spark, d), "user_id", "event_id", F.col("event_type") == "signup", F.col("class") == "R3")


QUERIES = {f.__name__: f for f in (volatile_cells, steady_columns, renamed_keys, type_families, horizon_buckets, normal_labels, judge_sources, reversibility, before_irreversible)}

_CLASS = "CASE WHEN event_type = 'view' THEN 'R0' WHEN event_type = 'click' THEN 'R1' WHEN event_type = 'purchase' THEN 'R2' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'R3' ELSE 'R0' END"

ORACLE = {
    "volatile_cells": f"""SELECT n_nationkey, {TABLES}[n_nationkey % 3 + 1] AS "table", c AS "column",
      (c IN ('created_at', 'last_seen_time', 'timestamp', 'created_by_vm_id', 'unread_count', 'canonical_row_key')) AND NOT (n_nationkey % 3 = 0 AND c = 'created_at') AND NOT (n_nationkey % 3 = 1 AND c = 'timestamp') AS volatile FROM (SELECT n_nationkey, unnest({COLUMNS}) AS c FROM nation)""",
    "steady_columns": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment AS title FROM customer",
    "renamed_keys": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS old, 'z' AS older, CASE WHEN n_nationkey % 3 = 0 THEN 'kept' ELSE n_name END AS new, NULL::VARCHAR AS other, 'o' AS name FROM nation""",
    "type_families": "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^eco', 'i') THEN 'low' WHEN regexp_matches(p_type, 'stan|med', 'i') THEN 'mid' WHEN regexp_matches(p_type, 'promo', 'i') THEN 'high' ELSE 'text' END AS family FROM part",
    "horizon_buckets": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'verifier_only' WHEN p_size % 6 = 1 THEN '1' WHEN p_size % 6 IN (2, 3) THEN '2-3' WHEN p_size % 6 >= 4 THEN '>=4' ELSE 'none' END AS bucket FROM part",
    "normal_labels": f"""WITH n(old, new, category, "group") AS (VALUES ('scope_error', 'scope_error', 'planning', 'long_horizon'), ('wrong_target', 'incorrect_ui_element', 'execution', 'local'), ('hallucinated_data', 'fabricate_data', 'planning', 'long_horizon'),
        ('ineffective_action', 'ineffective_action', 'perception', 'long_horizon'), ('premature_completion', 'premature_completion', 'termination', 'termination'), ('constraint_loss', 'scope_error', 'planning', 'long_horizon')),
      r AS (SELECT p_partkey, k, {LABELS}[(p_partkey * k + k) % 7 + 1] AS old FROM part, (VALUES (1), (2), (3)) AS v(k)),
      j AS (SELECT p_partkey, min(k) AS k, new, any_value(category) AS category, any_value("group") AS "group" FROM r JOIN n USING (old) GROUP BY p_partkey, new),
      a AS (SELECT p_partkey, string_agg(new, ',' ORDER BY k) AS labels FROM j GROUP BY 1), f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY list_position(['planning', 'perception', 'execution', 'termination'], category), k) = 1)
      SELECT p_partkey, coalesce(labels, '') AS labels, new AS first, category, "group" FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN f USING (p_partkey)""",
    "judge_sources": """WITH x AS (SELECT s_suppkey, 'supplier' || s_suppkey % 12 AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'xsupplier' || s_suppkey % 5 ELSE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') END AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)
      SELECT s_suppkey, a = b OR a LIKE '%' || b OR b LIKE '%' || a OR (a IN ('supplier1', 'nation2') AND b IN ('supplier1', 'nation2')) AS same FROM x""",
    "reversibility": f"""WITH x AS (SELECT user_id, {_CLASS} AS c FROM events) SELECT user_id, count(*) FILTER (c = 'R0') AS "R0", count(*) FILTER (c = 'R1') AS "R1", count(*) FILTER (c = 'R2') AS "R2", count(*) FILTER (c = 'R3') AS "R3", max(c) AS greatest FROM x GROUP BY 1""",
    "before_irreversible": f"""WITH x AS (SELECT user_id, event_id, event_type, {_CLASS} AS c FROM events), f AS (SELECT user_id, min(event_id) FILTER (c = 'R3') AS stop FROM x GROUP BY 1)
      SELECT f.user_id, CASE WHEN stop IS NOT NULL THEN count(*) FILTER (event_type = 'signup' AND event_id < stop) END AS n_before FROM f JOIN x USING (user_id) GROUP BY f.user_id, stop""",
}
