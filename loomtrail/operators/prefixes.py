"""Runs that are cut, repaired and compared: patches, renumbered prefixes, tails, consensus, and which runs are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patched(steps: DataFrame, patches: DataFrame, run: str, at: str, action: str, observations: list[str]) -> DataFrame:
    """Steps after patches (run, at, operation, old_action, new_action): dropped or replaced, with ``repaired``.

    What was observed after a run's first patch no longer holds and becomes null, but for the observation before that
    patch, the first of ``observations``. A patch of another action than it says, or of no step, is an error.
    """
    p = patches.select(run, at, "operation", "old_action", "new_action").withColumn("_p", F.lit(True))
    first = patches.groupBy(run).agg(F.min(at).alias("_first"))
    both = steps.withColumn("_s", F.lit(True)).join(p, [run, at], "full").join(first, run, "left")
    wrong = F.when(F.col("_s").isNull(), F.raise_error(F.lit("a patch of no step"))).when(F.col("_p") & ~F.col("old_action").eqNullSafe(F.col(action)), F.raise_error(F.lit("a patch of another action")))
    kept = both.withColumn("_w", wrong.cast("string")).where(F.col("_w").isNull() & ~(F.coalesce(F.col("operation"), F.lit("")) == "drop"))
    stale = F.col("_first").isNotNull() & (F.col(at) >= F.col("_first"))
    blank = [F.when(stale & ~((F.col(at) == F.col("_first")) & F.lit(i == 0)), None).otherwise(F.col(c)).alias(c) for i, c in enumerate(observations)]
    others = [c for c in steps.columns if c not in (run, at, action, *observations)]
    return kept.select(run, at, F.when(F.col("operation") == "replace", F.col("new_action")).otherwise(F.col(action)).alias(action), *blank, *others, F.coalesce(F.col("operation") == "replace", F.lit(False)).alias("repaired"))


def renumbered(steps: DataFrame, drops: DataFrame, roots: DataFrame, run: str, at: str) -> DataFrame:
    """Steps without the dropped ones before each run's root (run, root), with their new place; drops from the root on do not count."""
    gone = drops.join(roots, run).where(F.col(at) < F.col("root")).select(run, at)
    left = steps.join(gone.distinct(), [run, at], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(at)) - 1)


def depth_cases(steps: DataFrame, roots: DataFrame, run: str, at: str, depths: list[int]) -> DataFrame:
    """A case per run and depth whose prefix ends by the run's last step and by where its error shows (run, root, shows).

    ``steps`` are renumbered, so that a prefix is the places up to ``ends``. Runs whose root is gone have no case.
    """
    last = steps.groupBy(run).agg(F.max("place").alias("last"))
    begin = steps.join(roots.select(run, F.col("root").alias(at)), [run, at]).select(run, F.col("place").alias("root_place"))
    shown = steps.join(roots.select(run, "shows"), run).where(F.col(at) <= F.col("shows")).groupBy(run).agg(F.max("place").alias("shows_place"))
    grid = begin.join(last, run).join(shown, run).select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn("ends", F.col("root_place") + F.col("depth"))
    return grid.where("ends <= last and ends <= shows_place").select(run, "depth", "root_place", "shows_place", "ends")


def tail_differences(original: DataFrame, repaired: DataFrame, roots: DataFrame, run: str, at: str, fields: list[str]) -> DataFrame:
    """Steps from the root on that are not the same, null-safe, in the original and in the repaired run, or are in one only."""
    a, b = (df.join(roots, run).where(F.col(at) >= F.col("root")).select(run, at, F.struct(*fields).alias(n)) for df, n in ((original, "original"), (repaired, "repaired")))
    return a.join(b, [run, at], "full").where(~F.col("original").eqNullSafe(F.col("repaired"))).select(run, at, F.to_json("original").alias("original"), F.to_json("repaired").alias("repaired"))


def replay_mismatches(prefix: DataFrame, replay: DataFrame, history: DataFrame, run: str, at: str, action: str) -> DataFrame:
    """Steps of a prefix that the replay log or the native history lacks or has another action for, with what is wrong."""
    r, h = replay.select(run, at, F.col(action).alias("_r")), history.select(run, at, F.col(action).alias("_h"))
    both = prefix.select(run, at, action).join(r, [run, at], "left").join(h, [run, at], "left")
    why = F.when(F.col("_r").isNull(), "not replayed").when(F.col("_h").isNull(), "not in the history").when(F.col("_r") != F.col(action), "replayed otherwise").when(F.col("_h") != F.col(action), "other history")
    return both.select(run, at, why.alias("fault")).where("fault is not null")


def undeclared_writes(before: DataFrame, after: DataFrame, declared: DataFrame, table: str, digest: str) -> DataFrame:
    """Tables whose digest changed, came or went although no write was declared."""
    a, b = before.select(table, F.col(digest).alias("_a")), after.select(table, F.col(digest).alias("_b"))
    return a.join(b, table, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(table).join(declared.select(table).distinct(), table, "left_anti")


def agreed(proposals: DataFrame, case: str, reviewer: str, index: str, until: str, least: int) -> DataFrame:
    """Cases whose reviewers all propose the same ranges (index, until), each of which ends before the next begins.

    ``n_ranges`` counts them; a case of fewer reviewers than ``least``, of reviewers that differ, or of ranges that
    overlap is left out.
    """
    each = proposals.groupBy(case, reviewer).agg(F.array_sort(F.collect_set(F.struct(F.col(index).alias("index"), F.col(until).alias("until")))).alias("r"))
    same = each.groupBy(case).agg(F.count("*").alias("reviewers"), F.countDistinct("r").alias("kinds"), F.any_value("r").alias("ranges")).where((F.col("kinds") == 1) & (F.col("reviewers") >= least))
    n = F.size("ranges")
    apart = F.forall(F.sequence(F.lit(0), n - 1), lambda i: (F.get("ranges", i)["index"] <= F.get("ranges", i)["until"]) & ((i == n - 1) | (F.get("ranges", i)["until"] < F.get("ranges", F.least(i + 1, n - 1))["index"])))
    return same.where(apart).select(case, "reviewers", n.alias("n_ranges"), F.to_json("ranges").alias("ranges"))


def first_equivalent(facts: DataFrame, sightings: DataFrame, links: DataFrame) -> DataFrame:
    """The first sighting of each fact (fact, value), or of one that is linked to it either way (a, b, rule).

    A linked sighting counts if its value meets the rule: exact, or contains. Own sightings are exact.
    """
    both = links.select("a", "b", "rule").union(links.select("b", "a", "rule")).toDF("fact", "other", "rule").distinct()
    own = facts.select("fact", F.col("fact").alias("other"), F.lit("exact").alias("rule"))
    wanted = facts.join(own.unionByName(both).distinct(), "fact")
    seen = sightings.select(F.col("fact").alias("other"), F.col("value").alias("shown"), "at")
    fits = F.when(F.col("rule") == "contains", F.contains(F.lower("shown"), F.lower("value"))).otherwise(F.col("shown") == F.col("value"))
    first = wanted.join(seen, "other").where(fits).groupBy("fact").agg(F.min(F.struct("at", "other")).alias("f"))
    return facts.select("fact").join(first, "fact", "left").select("fact", F.col("f.at").alias("at"), F.col("f.other").alias("seen_as"))


def touching(state: DataFrame, pool: DataFrame) -> DataFrame:
    """Edges between ports of a state and of a pool of modules (task, port, direction, type), either way, between tasks that differ."""
    def edges(a: DataFrame, b: DataFrame, way: str) -> DataFrame:
        out, into = a.where("direction = 'out'").selectExpr("task as source", "port as source_port", "type"), b.where("direction = 'in'").selectExpr("task as target", "port as target_port", "type")
        return out.join(into, "type").where("source <> target").select("source", "source_port", "target", "target_port", F.lit(way).alias("way"))

    return edges(state, pool, "to pool").unionByName(edges(pool, state, "from pool"))


def other_row(rows: DataFrame, key: str, name: str, seed: int) -> DataFrame:
    """Another row for each: the next one of the same name in the order of hashes, in a circle, else the one of least hash of all others."""
    h = F.xxhash64(F.lit(seed), key)
    w = Window.partitionBy(name).orderBy("_h", key)
    ranked = rows.select(key, name, h.alias("_h")).withColumn("_next", F.coalesce(F.lead(key).over(w), F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    two = rows.orderBy(h, key).limit(2).agg(F.min(F.struct(h.alias("h"), key)).alias("a"), F.max(F.struct(h.alias("h"), key)).alias("b"))
    out = ranked.crossJoin(F.broadcast(two))  # one row on the right
    same = F.col("_next") != F.col(key)
    fallback = F.when(F.col(f"a.{key}") != F.col(key), F.col(f"a.{key}")).when(F.col(f"b.{key}") != F.col(key), F.col(f"b.{key}"))
    return out.select(key, F.when(same, F.col("_next")).otherwise(fallback).alias("other"), same.alias("same_name"))


def selection(runs: DataFrame, annotations: DataFrame, reviews: DataFrame, flags: DataFrame, agent: str, settled: DataFrame, repaired: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Failed runs whose takeover can be judged, or why not: a row per run with ``reason``, null if it is chosen.

    ``runs``: run, complete, provenance (whether its digests agree), agent, sha. ``annotations``: run, annotator, sha,
    label. ``reviews``: run, reviewer, sha, success. ``flags``: run, annotator, sha (a wrong rollout). ``settled``: run,
    label, where annotators were reconciled. An annotation counts if its own reviewer says that the run failed and did not
    flag it, all of them about this very run (sha). Several are one if they agree or if they were settled. Where repaired
    prefixes are asked for, ``repaired`` lists the runs (run, sha) that have a verified one. ``rejected`` lists runs (run,
    annotator) that were not taken in at all but have an annotation.
    """
    of_run = runs.select("run", "sha")
    flagged = flags.join(of_run, ["run", "sha"], "left_semi").select("run", "annotator").distinct()
    failed = reviews.where("success = false").select("run", F.col("reviewer").alias("annotator"), "sha").distinct()
    valid = annotations.join(of_run, ["run", "sha"], "left_semi").join(failed, ["run", "annotator", "sha"], "left_semi").join(flagged, ["run", "annotator"], "left_anti")
    per = valid.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.min_by(F.struct("annotator", "label"), "annotator").alias("first"), F.collect_set("label").alias("all"))
    per = per.join(settled.select("run", F.col("label").alias("settled")), "run", "left")
    per = per.withColumn("label", F.when(F.col("labels") == 1, F.col("first.label")).when(F.array_contains("all", F.col("settled")), F.col("settled")))
    out = runs.join(per, "run", "left").join(flagged.groupBy("run").agg(F.count("*").alias("n_flags")), "run", "left")
    # fixed values: the reasons
    reason = (
        F.when(~F.col("complete"), "incomplete_canonical").when(~F.col("provenance"), "provenance_mismatch").when(F.col("agent") != agent, "source_agent_mismatch")
        .when(F.col("n").isNull() & F.col("n_flags").isNotNull(), "wrong_rollout").when(F.col("n").isNull(), "no_human_failure_annotation").when(F.col("label").isNull(), "ambiguous_human_failure_annotations")
    )
    if repaired is not None:
        out = out.join(repaired.select("run", "sha").distinct().withColumn("has_repair", F.lit(True)), ["run", "sha"], "left")
        reason = F.coalesce(reason, F.when(F.col("has_repair").isNull(), "no_verified_repaired_prefix"))
    chosen = out.select("run", reason.alias("reason"), F.when(reason.isNull(), F.col("label")).alias("label"))
    if rejected is None:
        return chosen
    turned_away = rejected.select("run").distinct().join(runs.select("run"), "run", "left_anti")
    return chosen.unionByName(turned_away.select("run", F.lit("canonicalization_rejected").alias("reason"), F.lit(None).cast("string").alias("label")))


def judgeable(episodes: DataFrame, exclusions: DataFrame, files: DataFrame, key: list[str], required: str) -> DataFrame:
    """Completed episodes that are not excluded (by ``key``) and have the required file."""
    done = episodes.where(F.col("status") == "completed").join(exclusions.select(*key).distinct(), key, "left_anti")
    return done.join(files.where(F.col("file") == required).select(*key).distinct(), key, "left_semi")


def capped(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def bucket_fill(chosen: DataFrame, bucket: str, quotas: DataFrame) -> DataFrame:
    """Of each bucket of ``quotas`` (bucket, quota) how many were chosen and how many are missing."""
    n = chosen.groupBy(bucket).agg(F.count("*").alias("filled"))
    return quotas.join(n, bucket, "left").select(bucket, "quota", F.coalesce("filled", F.lit(0)).alias("filled"), F.greatest(F.col("quota") - F.coalesce("filled", F.lit(0)), F.lit(0)).alias("short"))
