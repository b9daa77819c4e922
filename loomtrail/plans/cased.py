"""Queries that plan cases and bundles from runs of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import cases
from loomtrail.plans.tables import EV, indexed_events

DEPTHS, MARKER = [0, 5, 10, 15, 20, 25], "[[evidence]]"
#: A case of each run, as SQL that Spark and DuckDB both read; n is the number of the run's steps.
_CASE = """concat('c', run) AS "case", run, CASE WHEN run % 23 = 5 THEN ' ' ELSE concat('s', run) END AS sha, CASE WHEN run % 19 = 4 THEN n + 1 WHEN run % 17 = 3 THEN 0 ELSE CAST(floor(n / 4) AS BIGINT) END AS root,
  CASE WHEN run % 29 = 1 THEN n + 5 WHEN run % 3 <> 0 THEN CAST(floor(n * 3 / 4) AS BIGINT) END AS identifiable, CASE WHEN run % 31 = 2 THEN run + 1 ELSE run END AS judged_run,
  CASE WHEN run % 19 = 4 THEN n + 1 WHEN run % 17 = 3 THEN 0 WHEN run % 37 = 8 THEN 1 ELSE CAST(floor(n / 4) AS BIGINT) END AS audit_root, CASE WHEN run % 23 = 5 THEN ' ' ELSE concat('s', run) END AS audit_sha, CASE WHEN run % 11 = 6 THEN n ELSE CAST(floor(n / 4) AS BIGINT) END AS audit_end"""
_SPARK_CASE = _CASE.replace('"case"', "`case`")


def _tables(spark, d):
    e = indexed_events(spark, d).selectExpr("user_id AS run", "idx AS at", "event_type AS action", "event_id", "CASE WHEN user_id % 34 <> 3 THEN true END AS observed")
    all_ = spark.sql(f"SELECT {_SPARK_CASE} FROM {{runs}}", runs=e.groupBy("run").agg(F.count("*").alias("n")))
    place = e.join(all_.select("run", "case", "root"), "run")
    patches = place.where("event_id % 9 = 4 and (at < root or run % 41 = 7)").select("case", "at", F.when(F.col("event_id") % 2 == 0, "drop").otherwise("replace").alias("operation"), F.lit("fixed").alias("new_action"), F.when(F.col("run") % 43 == 9, F.col("root") + 1).otherwise(F.col("root")).alias("root"))
    return e, all_, patches.union(patches.where("case like '%1'"))


def case_faults(spark, d):
    e, all_, patches = _tables(spark, d)
    return cases.case_faults(all_, e, patches, DEPTHS).select("case", "last", "audit_to", "fault")


def depth_instances(spark, d):
    e, all_, patches = _tables(spark, d)
    out = cases.depth_instances(cases.case_faults(all_, e, patches, DEPTHS), e, patches, DEPTHS)
    return out.withColumn("executed", F.array_join("executed", ","))


def bound_evidence(spark, d):
    """An annotation per user, about its run."""
    e = indexed_events(spark, d).groupBy(F.col("user_id").alias("run")).agg((F.count("*") - 1).alias("last"))
    runs = e.where("run % 10 <> 7").select("run", F.sha2(F.col("run").cast("string"), 256).alias("sha"), "last")
    a = e.selectExpr("concat('a', run) AS annotation", "run", "CASE WHEN run % 12 = 5 THEN '' ELSE 'w' END AS annotator", "CASE WHEN run % 6 = 1 THEN 'model' ELSE 'human' END AS role", "CASE WHEN run % 8 = 3 THEN 'no' WHEN run % 9 = 2 THEN sha2('other', 256) ELSE sha2(CAST(run AS STRING), 256) END AS sha", "CASE WHEN run % 14 = 8 THEN last + 1 ELSE 1 END AS root", f"concat('because ', CASE WHEN run % 15 = 4 THEN '' ELSE '{MARKER}' END, CASE WHEN run % 16 = 6 THEN ' ' ELSE concat(' seen ', run) END, CASE WHEN run % 20 = 14 THEN '{MARKER}' ELSE '' END) AS rationale")
    return cases.bound_evidence(a, runs, MARKER)


def prefix_bundles(spark, d):
    """The first half of each run is replayed, the rest comes later; every third step begins a turn."""
    e = indexed_events(spark, d).selectExpr("user_id AS run", "idx AS at", "event_type", "event_id")
    half = e.join(e.groupBy("run").agg(F.floor(F.count("*") / 2).alias("h")), "run")
    replay = half.where("at < h").selectExpr("run", "at AS place", "at", "CASE WHEN event_id % 97 <> 5 THEN concat('p', event_id) END AS shot")
    history = half.where("at < h").selectExpr("run", "at AS place", "CASE WHEN event_id % 89 = 3 THEN at + 1 ELSE at END AS at")
    canonical = e.where("event_id % 83 <> 2").selectExpr("run", "at", "at div 3 AS turn", "CASE WHEN event_id % 5 <> 0 THEN concat('m', event_id) END AS message", "event_type AS summary", "CASE WHEN event_id % 7 = 0 THEN concat('r', event_id) END AS tool_result")
    later = half.where("at >= h").selectExpr("run", "at AS place", "concat('m', event_id) AS message", "event_type AS summary", "concat('p', event_id) AS shot")
    out = cases.prefix_bundles(replay, history, canonical, later)
    return out.select("run", "n_prefix", "n_later", F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["step"], s["message"], s["summary"], s["shot"])), ";").alias("steps"), "fault")


def final_states(spark, d):
    """The last event of each user as a probe with two outputs."""
    e = indexed_events(spark, d).selectExpr("user_id AS run", "idx AS line", "event_type", "event_id")
    probes = e.selectExpr("run", "line", "'b' AS name", "concat(event_type, '  ') AS output", "CASE WHEN event_id % 3 = 0 THEN md5(event_type) END AS fingerprint").union(e.selectExpr("run", "line", "'a'", "CAST(event_id AS STRING)", "CASE WHEN event_id % 3 = 0 THEN md5(event_type) END"))
    return cases.final_states(probes, 40)


QUERIES = {f.__name__: f for f in (case_faults, depth_instances, bound_evidence, prefix_bundles, final_states)}

_PLAN = f"""{EV}, e AS (SELECT user_id AS run, idx AS k, event_type AS action, event_id FROM ev), c AS (SELECT {_CASE}, n FROM (SELECT run, count(*) AS n FROM e GROUP BY run)),
  p AS (SELECT "case", k, CASE WHEN event_id % 2 = 0 THEN 'drop' ELSE 'replace' END AS op, run, root FROM e JOIN c USING (run) WHERE event_id % 9 = 4 AND (k < root OR run % 41 = 7)),
  x AS (SELECT "case", bool_or(run % 43 = 9) AS other, bool_or(k >= root) AS late, bool_or("case" LIKE '%1') AS twice FROM p GROUP BY 1),
  f AS (SELECT c.*, n - 1 AS last, (SELECT max(root + dd) FROM (SELECT unnest({DEPTHS}) AS dd) WHERE root + dd <= n - 1) AS audit_to, x.other, x.late, x.twice FROM c LEFT JOIN x USING ("case")),
  z AS (SELECT *, CASE WHEN trim(sha) = '' THEN 'no provenance' WHEN judged_run <> run THEN 'judgement of another run' WHEN root > last THEN 'root beyond the run' WHEN root = 0 AND run % 34 = 3 THEN 'no first observation' WHEN identifiable > last THEN 'horizon beyond the run'
    WHEN other THEN 'patch with another root' WHEN audit_root <> root THEN 'audit of another source' WHEN audit_end > audit_to THEN 'audit beyond the deepest cut' WHEN twice THEN 'several patches of a step' WHEN late THEN 'patch at or behind the root' END AS fault FROM f)"""
ORACLE = {
    "case_faults": f"""WITH {_PLAN} SELECT "case", last, audit_to, fault FROM z""",
    "depth_instances": f"""WITH {_PLAN}, i AS (SELECT "case", run, dd AS depth, root + dd AS replay_end FROM z, (SELECT unnest({DEPTHS}) AS dd) WHERE fault IS NULL AND root + dd <= last AND root + dd <= identifiable)
      SELECT "case" || '-d' || depth AS instance, "case", depth, replay_end, string_agg(k, ',' ORDER BY k) AS executed, sha256(string_agg(k || ':' || CASE WHEN op = 'replace' THEN 'fixed' ELSE action END, chr(10) ORDER BY k)) AS actions_sha256
      FROM i JOIN e USING (run) LEFT JOIN (SELECT DISTINCT "case", k, op FROM p) q USING ("case", k) WHERE k <= replay_end AND op IS DISTINCT FROM 'drop' GROUP BY 1, 2, 3, 4""",
    "bound_evidence": f"""WITH e AS (SELECT user_id AS run, count(*) - 1 AS last FROM events GROUP BY 1), f AS (SELECT run, CASE WHEN run % 6 = 1 THEN 'not human' WHEN run % 12 = 5 THEN 'a text is missing' WHEN run % 8 = 3 THEN 'no sha256' WHEN run % 10 = 7 THEN 'unknown run' WHEN CASE WHEN run % 14 = 8 THEN last + 1 ELSE 1 END > last THEN 'root beyond the run'
        WHEN run % 9 = 2 THEN 'another source' WHEN (run % 15 = 4)::INT = (run % 20 <> 14)::INT THEN 'not one marker' WHEN run % 15 = 4 OR run % 16 = 6 THEN 'no evidence' END AS fault FROM e)
      SELECT 'a' || run AS annotation, run, CASE WHEN fault IS NULL THEN 'seen ' || run END AS evidence, fault FROM f""",
    "prefix_bundles": f"""WITH {EV}, e AS (SELECT user_id AS run, idx AS k, event_type AS y, event_id AS i, count(*) OVER (PARTITION BY user_id) // 2 AS h FROM ev),
      r AS (SELECT *, CASE WHEN i % 83 <> 2 THEN k // 3 END AS turn FROM e WHERE k < h), t AS (SELECT *, k > 0 AND turn IS NOT DISTINCT FROM lag(turn) OVER (PARTITION BY run ORDER BY k) AS same FROM r),
      m AS (SELECT *, CASE WHEN i % 7 = 0 AND i % 83 <> 2 AND (same OR i % 5 = 0) THEN 'r' || i WHEN same THEN '(same model turn as the previous step)' WHEN i % 5 <> 0 AND i % 83 <> 2 THEN 'm' || i ELSE '' END AS msg FROM t),
      s AS (SELECT run, k, 'prefix_' || k || '|' || msg || '|' || y || '|p' || i AS s FROM m UNION ALL SELECT run, k, k || '|m' || i || '|' || y || '|p' || i FROM e WHERE k >= h),
      f AS (SELECT run, max(h) AS n_prefix, count(*) - max(h) AS n_later, CASE WHEN bool_or(k < h AND i % 89 = 3) THEN 'replay and history differ' WHEN bool_or(k < h AND i % 83 = 2) THEN 'a step is not in the run' WHEN bool_or(k < h AND i % 97 = 5) THEN 'a picture is missing' END AS fault FROM e WHERE h > 0 GROUP BY run)
      SELECT f.run, n_prefix, n_later, CASE WHEN fault IS NULL THEN (SELECT string_agg(s, ';' ORDER BY k) FROM s WHERE s.run = f.run) END AS steps, fault FROM f""",
    "final_states": f"""WITH {EV}, l AS (SELECT user_id AS run, idx AS line, '[a]' || chr(10) || event_id || chr(10) || '[b]' || chr(10) || event_type || CASE WHEN event_id % 3 = 0 THEN chr(10) || 'State fingerprint (sha256): ' || md5(event_type) ELSE '' END AS t FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) = 1)
      SELECT run, line, CASE WHEN length(t) > 40 THEN left(t, 40) || chr(10) || '... [truncated to 40 characters]' ELSE t END AS text FROM l""",
}
