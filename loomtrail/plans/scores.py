"""Queries over scores of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrail.operators import metrics
from loomtrail.plans.tables import EV, indexed_events, table

TYPES = ["click", "error", "purchase", "signup", "view", "share", "refund"]


def rubric_verdict(spark, d):
    return metrics.rubric_verdict(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.col("l_returnflag") != "R")


def _runs(spark, d):
    run = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    passed = F.col("o_orderstatus") == "F"
    score = F.when(passed, 1.0).otherwise((F.col("o_orderkey") % 10) / 10.0)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), run.alias("run"), passed.alias("passed"), score.alias("score"))


def pass_at_k(spark, d):
    return metrics.pass_at_k(table(spark, d, "customer"), _runs(spark, d), "c_custkey", 3)


def pass_at_k_summary(spark, d):
    out = metrics.pass_at_k(table(spark, d, "customer"), _runs(spark, d), "c_custkey", 3)
    return out.agg(F.count("*").alias("n_units"), F.count_if(F.col("n_runs") == 0).alias("n_missing"), F.count_if(F.col("n_runs").between(1, 2)).alias("n_incomplete"), F.count_if("solved").alias("n_solved"))


def awareness(spark, d):
    e = indexed_events(spark, d)
    labels = F.array("event_type", F.when(F.col("value") > 80, "large").otherwise(F.col("event_type")))
    aware = F.when(F.col("value") >= 10, F.col("value") > 50)
    units = e.select(F.col("event_id").alias("unit"), (F.col("idx") % 6 * 5).alias("depth"), labels.alias("labels"), aware.alias("aware"))
    return metrics.awareness_table(units, "unit", "depth", "labels", "aware")


def any_of_repeats(spark, d):
    return metrics.any_of_repeats(table(spark, d, "events").withColumn("aware", F.col("value") > 90), ["user_id", "event_type"], "aware")


def episode_metrics(spark, d):
    v = F.col("value")
    return metrics.episode_metrics(table(spark, d, "events"), "event_type", v >= 5, {"aware": v > 50, "recovered": v > 75})


def type_distribution(spark, d):
    taxonomy = spark.createDataFrame([(t,) for t in TYPES], "event_type string")
    return metrics.distribution(table(spark, d, "events"), "event_type", taxonomy)


def rubric_pivot(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"]
    return metrics.rank_pivot(table(spark, d, "lineitem"), "l_orderkey", order, "l_quantity", F.col("l_returnflag") != "R", 4)


def rubric_means(spark, d):
    return metrics.mean_and_perfect(rubric_pivot(spark, d), "percent")


def style_statistics(spark, d):
    return metrics.style(table(spark, d, "conversations"), "role", "text", r"\b(The|Tion)[a-z]*\b")


def balance_weights(spark, d):
    return metrics.balance_weights(table(spark, d, "documents"), "lang", 0.5)


def dataset_manifest(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.sum("n_chars").alias("chars"))


def reviewer_disagreement(spark, d):
    return metrics.disagreement(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


def rejection_rate(spark, d):
    return metrics.rejection_rate(table(spark, d, "events"), "event_type", F.col("value") > 30, F.col("value") > 95)


def primary_mode(spark, d):
    return metrics.primary_mode(table(spark, d, "events"), "user_id", F.col("event_type").isin("click", "view"), 0.7)


def length_quartiles(spark, d):
    return metrics.quartiles(table(spark, d, "documents"), "lang", "n_chars")


QUERIES = {f.__name__: f for f in (rubric_verdict, pass_at_k, pass_at_k_summary, awareness, any_of_repeats, episode_metrics, type_distribution, rubric_pivot, rubric_means, style_statistics, balance_weights, dataset_manifest, reviewer_disagreement, rejection_rate, primary_mode, length_quartiles)}

_RUNS = """r AS (SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run, o_orderstatus = 'F' AS passed,
  CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS score FROM orders),
p AS (SELECT c_custkey, count(*) AS n_runs, bool_or(passed) AS solved, coalesce(arg_min(score, run) FILTER (passed), max(score)) AS score FROM r WHERE run <= 3 GROUP BY 1),
u AS (SELECT c_custkey, coalesce(n_runs, 0) AS n_runs, coalesce(solved, false) AS solved, coalesce(score, 0)::DOUBLE AS score FROM customer LEFT JOIN p USING (c_custkey))"""

ORACLE = {
    "rubric_verdict": """SELECT l_orderkey, count(*) AS n_criteria, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS gained, sum(l_quantity) AS total,
      bool_and(l_returnflag <> 'R') AS passed, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS score FROM lineitem GROUP BY 1""",
    "pass_at_k": f"WITH {_RUNS} SELECT * FROM u",
    "pass_at_k_summary": f"WITH {_RUNS} SELECT count(*) AS n_units, count(*) FILTER (n_runs = 0) AS n_missing, count(*) FILTER (n_runs BETWEEN 1 AND 2) AS n_incomplete, count(*) FILTER (solved) AS n_solved FROM u",
    "awareness": f"""WITH {EV}, b AS (SELECT event_id, idx % 6 * 5 AS depth, list_distinct([event_type, CASE WHEN value > 80 THEN 'large' ELSE event_type END]) AS ls, CASE WHEN value >= 10 THEN value > 50 END AS aware FROM ev),
      l AS (SELECT depth, unnest(ls) AS label, aware FROM b),
      x AS (SELECT depth, 'ALL' AS label, count(*) AS n_units, count(aware) AS n_judged, count(*) FILTER (aware) AS n_aware FROM b GROUP BY GROUPING SETS ((depth), ())
        UNION ALL SELECT depth, label, count(*), count(aware), count(*) FILTER (aware) FROM l GROUP BY GROUPING SETS ((depth, label), (label)))
      SELECT *, CASE WHEN n_judged > 0 THEN n_aware / n_judged END AS rate_judged, n_aware / n_units AS rate_all FROM x""",
    "any_of_repeats": "SELECT user_id, event_type, bool_or(value > 90) AS aware, count(*) AS n_repeats FROM events GROUP BY 1, 2",
    "episode_metrics": """SELECT event_type, count(*) AS n_episodes, count(*) FILTER (value >= 5) AS n_valid, count(*) FILTER (value < 5) / count(*) AS invalid_rate,
      avg((value > 50)::INT::DOUBLE) FILTER (value >= 5) AS mean_aware, avg((value > 75)::INT::DOUBLE) FILTER (value >= 5) AS mean_recovered FROM events GROUP BY 1""",
    "type_distribution": f"""SELECT t.event_type, count(e.event_id) AS n, count(e.event_id)::DOUBLE / (SELECT count(*) FROM events) AS share
      FROM (SELECT unnest({TYPES!r}) AS event_type) t LEFT JOIN events e USING (event_type) GROUP BY 1""",
    "rubric_pivot": """WITH r AS (SELECT *, l_returnflag <> 'R' AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag) AS k FROM lineitem)
      SELECT l_orderkey, max(CASE WHEN k = 1 THEN s::INT END) AS R1, max(CASE WHEN k = 2 THEN s::INT END) AS R2, max(CASE WHEN k = 3 THEN s::INT END) AS R3, max(CASE WHEN k = 4 THEN s::INT END) AS R4,
      sum(CASE WHEN s THEN l_quantity ELSE 0 END) AS gained, sum(l_quantity) AS total, round(100 * sum(CASE WHEN s THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) AS percent FROM r GROUP BY 1""",
    "rubric_means": """SELECT count(*) AS n_runs, round(avg(p), 6) AS mean, count(*) FILTER (p = 100) / count(*) AS perfect_share FROM (SELECT round(100 * sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) AS p FROM lineitem GROUP BY l_orderkey)""",
    "style_statistics": r"""WITH x AS (SELECT role, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w, regexp_matches(text, '\b(I|my|me)\b') AS me, len(regexp_extract_all(text, '\b(The|Tion)[a-z]*\b')) AS k FROM conversations),
      r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM x)
      SELECT role, count(*) AS n, round(count(*) FILTER (me) / count(*), 2) AS first_person, round(sum(k) / count(*), 2) AS mentions, max(w) FILTER (i = n // 4)::INT AS p25, max(w) FILTER (i = n * 2 // 4)::INT AS median, max(w) FILTER (i = n * 3 // 4)::INT AS p75 FROM r GROUP BY 1""",
    "balance_weights": "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, greatest(0.5::DOUBLE, round((SELECT sum(n)::BIGINT FROM n) / ((SELECT count(*) FROM n) * n), 4)) AS weight FROM n",
    "dataset_manifest": "SELECT lang, source, count(*) AS n, count(DISTINCT text) AS n_texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2",
    "reviewer_disagreement": """SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_linestatus) AS n_l_linestatus,
      concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END) AS differs FROM lineitem GROUP BY 1""",
    "rejection_rate": """SELECT event_type, count(*) AS n, count(*) FILTER (value > 30 AND value <= 95) / nullif(count(*) FILTER (value <= 95), 0) AS rate_exclude,
      count(*) FILTER (value > 30 OR value > 95) / count(*) AS rate_caught, count(*) FILTER (value > 30 AND value <= 95) / count(*) AS rate_missed FROM events GROUP BY 1""",
    "primary_mode": """WITH n AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS n_first, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_second FROM events GROUP BY 1)
      SELECT *, CASE WHEN n_first >= 0.7::DOUBLE * (n_first + n_second) THEN 'first' WHEN n_second >= 0.7::DOUBLE * (n_first + n_second) THEN 'second' ELSE 'mixed' END AS main FROM n""",
    "length_quartiles": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
      SELECT lang, median(n_chars) AS median, max(n_chars) FILTER (k = n * 1 // 4) AS q1, max(n_chars) FILTER (k = n * 2 // 4) AS q2, max(n_chars) FILTER (k = n * 3 // 4) AS q3 FROM r GROUP BY 1""",
}
