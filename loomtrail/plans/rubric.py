"""Queries over criteria, expectations and verdicts; documents, events and orders stand in for tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import rubrics
from loomtrail.plans.tables import table


def _criteria(spark, d):
    """Three criteria per customer with dates in several forms, amounts, addresses and quotations."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate")
    text = F.concat(
        F.lit("Due "), F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "MMMM d, yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "MMM d")).otherwise(F.date_format(day, "M/d/yyyy")),
        F.lit(" for $"), F.format_number("o_totalprice", 2), F.lit(' to A'), F.col("o_custkey"), F.lit('@X.org about "'), F.col("o_orderpriority"), F.lit('" or "to <name> now".'),
    )
    return o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 5).cast("double").alias("weight"), text.alias("text"))


def expected_values(spark, d):
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), F.when(F.col("c_custkey") % 2 == 0, "3-MEDIUM").otherwise("low").alias("value"))
    return rubrics.expected_values(_criteria(spark, d), "task", "place", "weight", "text", 2026, v)


def expectations_met(spark, d):
    o = table(spark, d, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(F.col("o_orderkey") % 3 == 1, (F.col("o_totalprice") * 1.004).cast("string")).otherwise(F.concat(F.lit("As "), F.lower("o_orderpriority"), F.lit(" $"), F.format_number("o_totalprice", 2)))
    e = rubrics.expected_values(_criteria(spark, d), "task", "place", "weight", "text", 2026)
    return rubrics.met(e, "task", o.select(F.col("o_custkey").alias("task"), shown.alias("value"))).select("task", "kind", "value", "met")


def variables_filled(spark, d):
    v = F.concat(F.lit("from ${TODAY} to ${TODAY+"), F.col("o_orderkey") % 40, F.lit("}, not ${TODAY-3}"))
    return table(spark, d, "orders").select("o_orderkey", rubrics.filled(v, F.col("o_orderdate").cast("date")).alias("value"))


def satisfied_share(spark, d):
    l = table(spark, d, "lineitem").withColumn("w", F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(F.col("l_quantity")))
    return rubrics.satisfied_share(l, "l_orderkey", "w", F.col("l_returnflag") != "R")


def _verdicts(spark, d):
    e = table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").select("l_orderkey", (F.col("l_linestatus") == "O").alias("met"))
    return rubrics.verdicts(e, "l_orderkey", satisfied_share(spark, d), 2, 0.8, 0.7)


def verdict_codes(spark, d):
    return _verdicts(spark, d).select("l_orderkey", "n", "n_met", "code", "verdict")


def verdict_crosstab(spark, d):
    return rubrics.accepted_share(_verdicts(spark, d), "verdict", "code", 0.5)


def human_scores(spark, d):
    w = F.when(F.col("l_linenumber") == 2, "none").when(F.col("l_linenumber") == 3, "-4").otherwise(F.col("l_quantity").cast("string"))
    s = F.when(F.col("l_orderkey") % 4 == 0, 1.5).otherwise(F.col("l_discount") * 20 - 0.3)
    out = rubrics.human_score(table(spark, d, "lineitem").select("l_orderkey", w.alias("w"), s.alias("s")), "l_orderkey", "w", "s")
    return out.withColumn("score", F.round("score", 9))


def flat_values(spark, d):
    n = table(spark, d, "nation")
    j = F.to_json(F.struct(F.col("n_name").alias("a"), F.struct(F.array(F.col("n_nationkey"), F.lit(-2)).alias("x"), F.lit('q"t').alias("y")).alias("b"), (F.col("n_nationkey") > 3).alias("c")))
    return n.select("n_nationkey", F.array_join(rubrics.flat_values(j), "|").alias("v"))


def without_private_keys(spark, d):
    n = table(spark, d, "nation")
    j = F.to_json(F.struct(F.lit("hm").alias("thought"), F.col("n_name").alias("a"), F.struct(F.lit("x").alias("y"), F.lit(1).alias("reasoning")).alias("b"), F.lit("z").alias("thought2")))
    return n.select("n_nationkey", rubrics.without_keys(j, ["thought", "reasoning"]).alias("j"))


def hidden_values(spark, d):
    o = table(spark, d, "orders")
    public = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("task"), F.concat(F.lit("see "), F.lower("o_orderpriority")).alias("t"))
    return rubrics.hidden_values(o.select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("value")), "task", "value", public, "t")


def literals_allowed(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    literal = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, (F.col("o_custkey") * 1000).cast("string")).when(k == 2, F.col("o_orderpriority")).otherwise("absent")
    text = F.concat(F.lit("By "), F.date_format("o_orderdate", "MMMM d"), F.lit(" pay "), F.format_number(F.col("o_custkey") * 1000, 0), F.lit(" as "), F.lower("o_orderpriority"))
    return o.select("o_orderkey", rubrics.literal_allowed(literal, text).alias("allowed"))


QUERIES = {f.__name__: f for f in (expected_values, expectations_met, variables_filled, satisfied_share, verdict_codes, verdict_crosstab, human_scores, flat_values, without_private_keys, hidden_values, literals_allowed)}

# as the rule for "Sept" has it, a September that is written out is no date
_E = """b AS (SELECT o_custkey AS task, o_orderkey AS place, (o_orderkey % 5)::DOUBLE AS weight, o_orderdate AS d, o_totalprice AS p, o_orderpriority AS q FROM orders),
  v AS (SELECT task, place, weight, 'date' AS kind, CASE WHEN place % 4 = 2 THEN '2026' || strftime(d, '-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS value FROM b WHERE NOT (place % 4 = 2 AND strftime(d, '%m-%d') = '02-29') AND NOT (place % 4 = 1 AND month(d) = 9)
    UNION ALL SELECT task, place, weight, 'amount', round(p, 2)::DOUBLE::VARCHAR FROM b UNION ALL SELECT task, place, weight, 'email', 'a' || task || '@x.org' FROM b UNION ALL SELECT task, place, weight, 'text', q FROM b{more}),
  x AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY task, kind, value ORDER BY weight DESC, place) = 1)"""
_SHARE = "h AS (SELECT l_orderkey, round_even(CASE WHEN l_orderkey % 4 <> 0 THEN sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) ELSE count(*) FILTER (l_returnflag <> 'R') / count(*) END, 4) AS share FROM lineitem GROUP BY 1)"
_VERDICT = f"""{_SHARE}, n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_met FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1),
  c AS (SELECT l_orderkey, coalesce(n, 0) AS n, coalesce(n_met, 0) AS n_met, CASE WHEN n >= 2 AND n_met >= 0.8::DOUBLE * n THEN 'expectations_met' WHEN n >= 2 THEN 'expectations_missed' WHEN share >= 0.7::DOUBLE THEN 'words_covered' ELSE 'words_missed' END AS code FROM h LEFT JOIN n USING (l_orderkey)),
  r AS (SELECT *, CASE WHEN code IN ('expectations_met', 'words_covered') THEN 'auto_validated' ELSE 'needs_review' END AS verdict FROM c)"""

ORACLE = {
    "expected_values": f"""WITH {_E.format(more=" UNION ALL SELECT task, place, weight, 'variable', '3-MEDIUM' FROM b WHERE task % 2 = 0 AND q = '3-MEDIUM'")} SELECT task, kind, value, place, weight FROM x""",
    "expectations_met": rf"""WITH {_E.format(more="")}, s AS (SELECT o_custkey AS task, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice * 1.004 AS near, round(o_totalprice, 2) AS p, lower(o_orderpriority) AS q FROM orders),
      m AS (SELECT DISTINCT x.task, kind, value FROM x JOIN s ON s.task = x.task WHERE (kind = 'date' AND k = 0 AND day = value) OR (kind = 'amount' AND ((k = 1 AND abs(near - value::DOUBLE) <= greatest(abs(value::DOUBLE) * 0.005::DOUBLE, 0.005::DOUBLE)) OR (k = 2 AND abs(p - value::DOUBLE) <= 0.005::DOUBLE)))
        OR (kind = 'text' AND k = 2 AND contains(q, lower(value))))
      SELECT x.task, x.kind, x.value, m.task IS NOT NULL AS met FROM x LEFT JOIN m ON m.task = x.task AND m.kind = x.kind AND m.value = x.value""",
    "variables_filled": "SELECT o_orderkey, 'from ' || strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + to_days((o_orderkey % 40)::INT), '%Y-%m-%d') || ', not ' || strftime(o_orderdate - to_days(3), '%Y-%m-%d') AS value FROM orders",
    "satisfied_share": f"WITH {_SHARE} SELECT * FROM h",
    "verdict_codes": f"WITH {_VERDICT} SELECT l_orderkey, n, n_met, code, verdict FROM r",
    "verdict_crosstab": f"WITH {_VERDICT}, a AS (SELECT count(*) FILTER (verdict = 'auto_validated') / count(*) AS accepted FROM r) SELECT verdict, code, count(*) AS n, accepted, accepted >= 0.5::DOUBLE AS passes FROM r, a GROUP BY verdict, code, accepted",
    "human_scores": """WITH x AS (SELECT l_orderkey, CASE WHEN l_linenumber IN (2, 3) OR l_quantity <= 0 THEN 1.0::DOUBLE ELSE l_quantity END AS w, least(greatest(CASE WHEN l_orderkey % 4 = 0 THEN 1.5::DOUBLE ELSE l_discount * 20::DOUBLE - 0.3::DOUBLE END, 0), 1)::DOUBLE AS s FROM lineitem)
      SELECT l_orderkey, round(sum(w * s) / sum(w), 9) AS score, bool_and(s = 1) AS all_pass FROM x GROUP BY 1""",
    "flat_values": """SELECT n_nationkey, n_name || '|' || n_nationkey || '|-2|q"t|' || (n_nationkey > 3) AS v FROM nation""",
    "without_private_keys": """SELECT n_nationkey, '{"a":"' || n_name || '","b":{"y":"x"},"thought2":"z"}' AS j FROM nation""",
    "hidden_values": """WITH v AS (SELECT DISTINCT o_custkey AS task, o_orderpriority AS value FROM orders) SELECT task, value FROM v WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = task AND o_orderkey % 2 = 0 AND contains('see ' || lower(o_orderpriority), lower(value)))""",
    "literals_allowed": "SELECT o_orderkey, o_orderkey % 4 <> 3 AS allowed FROM orders",
}
