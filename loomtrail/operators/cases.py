"""Cases that a takeover starts from: plans with an instance per depth, bound evidence, and bundles of prefixes.

A case is a row with what is wrong with it, or none; nothing raises for the sake of one case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a message says that goes on from the last one (fixed value).
CONTINUED = "(same model turn as the previous step)"


def _first(*faults: tuple[Column, str]) -> Column:
    """The first fault whose condition holds; a condition that is null does not."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), text) for c, text in faults))


def case_faults(cases: DataFrame, steps: DataFrame, patches: DataFrame, depths: list[int]) -> DataFrame:
    """``cases`` with last (the run's last step), audit_to (the deepest cut) and fault.

    ``cases``: case, run, sha, root, identifiable, judged_run, audit_root, audit_sha, audit_end. ``steps``: run, at, action,
    observed (what was seen before is kept). ``patches``: case, at, operation (drop or replace), new_action, root.
    """
    of_run = steps.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("at").alias("n_places"), F.min("at").alias("first"), F.max("at").alias("last"), F.bool_or((F.col("at") == 0) & F.col("observed")).alias("seen_first"))
    patched = patches.join(cases.select("case", F.col("root").alias("_root")), "case").groupBy("case").agg(F.bool_or(F.col("root") != F.col("_root")).alias("other_root"), F.bool_or(F.col("at") >= F.col("_root")).alias("late"))
    twice = patches.groupBy("case", "at").count().where("count > 1").select("case").distinct().withColumn("twice", F.lit(True))
    out = cases.join(of_run, "run", "left").join(patched, "case", "left").join(twice, "case", "left")
    deepest = F.array_max(F.filter(F.array(*map(F.lit, depths)), lambda d: F.col("root") + d <= F.col("last")))
    blank = reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in ("case", "run", "sha")))
    fault = _first(
        (blank, "no provenance"), (F.col("n").isNull() | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("n") != F.col("n_places")), "steps are not contiguous"),
        (~F.col("judged_run").eqNullSafe(F.col("run")), "judgement of another run"), (F.col("root").isNull() | (F.col("root") < 0) | (F.col("root") > F.col("last")), "root beyond the run"),
        ((F.col("root") == 0) & ~F.coalesce("seen_first", F.lit(False)), "no first observation"), (F.col("identifiable") > F.col("last"), "horizon beyond the run"),
        (F.col("other_root"), "patch with another root"), (~(F.col("audit_root").eqNullSafe(F.col("root")) & F.col("audit_sha").eqNullSafe(F.col("sha"))), "audit of another source"),
        (F.col("audit_end") > F.col("root") + deepest, "audit beyond the deepest cut"), (F.col("twice"), "several patches of a step"), (F.col("late"), "patch at or behind the root"),
    )
    return out.select(*cases.columns, "last", (F.col("root") + deepest).alias("audit_to"), fault.alias("fault"))


def depth_instances(faults: DataFrame, steps: DataFrame, patches: DataFrame, depths: list[int], explicit: bool = True) -> DataFrame:
    """An instance per sound case and depth: instance, case, depth, replay_end, executed (places), actions_sha256.

    A depth ends by the run's last step and by the step where its error can be seen, which must be known with ``explicit``.
    Patched steps are dropped or have their new action; the digest is of place and action of all executed steps.
    """
    sound = faults.where("fault is null")
    acts = steps.join(sound.select("case", "run", "audit_to"), "run").where("at <= audit_to").join(patches.select("case", "at", "operation", "new_action"), ["case", "at"], "left")
    kept = acts.where("operation is null or operation <> 'drop'").select("case", "at", F.when(F.col("operation") == "replace", F.col("new_action")).otherwise(F.col("action")).alias("action"))
    lists = kept.groupBy("case").agg(F.sort_array(F.collect_list(F.struct("at", "action"))).alias("all"))
    each = sound.select("case", "root", "last", "identifiable", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn("replay_end", F.col("root") + F.col("depth"))
    each = each.where("replay_end <= last").where(F.coalesce(F.col("replay_end") <= F.col("identifiable"), F.lit(not explicit)))
    own = F.filter("all", lambda s: s["at"] <= F.col("replay_end"))
    out = each.join(lists, "case").withColumn("own", own)
    digest = F.sha2(F.array_join(F.transform("own", lambda s: F.concat_ws(":", s["at"].cast("string"), s["action"])), "\n"), 256)
    return out.select(F.format_string("%s-d%d", F.col("case").cast("string"), "depth").alias("instance"), "case", "depth", "replay_end", F.transform("own", lambda s: s["at"]).alias("executed"), digest.alias("actions_sha256"))


def bound_evidence(annotations: DataFrame, runs: DataFrame, marker: str) -> DataFrame:
    """annotation, run, evidence and fault of each annotation: its text behind the one marker, if it is bound to the run as it is.

    ``annotations``: annotation, run, annotator, role, sha, root, rationale; ``runs``: run, sha, last.
    """
    r = runs.select("run", F.col("sha").alias("_sha"), "last")
    out = annotations.join(r, "run", "left")
    count = (F.length("rationale") - F.length(F.replace("rationale", F.lit(marker), F.lit("")))) / len(marker)
    evidence = F.trim(F.split_part("rationale", F.lit(marker), F.lit(2)))
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    fault = _first(
        (~F.col("role").eqNullSafe("human"), "not human"), (empty("annotation") | empty("run") | empty("annotator") | empty("sha") | empty("rationale"), "a text is missing"), (~F.col("sha").rlike(r"\A[0-9a-f]{64}\z"), "no sha256"),
        (F.col("root").isNull() | (F.col("root") < 0), "no root"), (F.col("_sha").isNull(), "unknown run"), (F.col("root") > F.col("last"), "root beyond the run"), (F.col("sha") != F.col("_sha"), "another source"),
        (count != 1, "not one marker"), (evidence == "", "no evidence"),
    )
    return out.select("annotation", "run", F.when(fault.isNull(), evidence).alias("evidence"), fault.alias("fault"))


def prefix_bundles(replay: DataFrame, history: DataFrame, canonical: DataFrame, later: DataFrame) -> DataFrame:
    """run, n_prefix, n_later, steps and fault: the steps that were replayed, with their messages, before the later ones.

    ``replay``: run, place, at, shot; ``history``: run, place, at; ``canonical``: run, at, turn, message, summary, tool_result;
    ``later``: run, place, message, summary, shot. The first step of a turn has its message, the others go on; a tool's result is added
    to a step that has no message of its own. Replay and history must name the same steps, and each must be in the run and have a picture.
    """
    differ = replay.select("run", "place", "at").exceptAll(history.select("run", "place", "at")).union(history.select("run", "place", "at").exceptAll(replay.select("run", "place", "at"))).select("run").distinct().withColumn("differs", F.lit(True))
    rows = replay.join(canonical.withColumn("_in", F.lit(True)), ["run", "at"], "left")
    before = Window.partitionBy("run").orderBy("place")
    same = F.col("turn").eqNullSafe(F.lag("turn").over(before)) & (F.row_number().over(before) > 1)
    own = F.when(same, F.lit(CONTINUED)).otherwise(F.coalesce("message", F.lit("")))
    bare = own.isin("", CONTINUED) & (F.coalesce("tool_result", F.lit("")) != "")
    message = F.when(bare, F.col("tool_result")).otherwise(own)
    step = F.struct("place", F.concat(F.lit("prefix_"), F.col("at").cast("string")).alias("step"), message.alias("message"), F.col("summary"), F.col("shot"))
    rows = rows.withColumn("s", step)
    per = rows.groupBy("run").agg(F.count("*").alias("n_prefix"), F.sort_array(F.collect_list("s")).alias("prefix"), F.bool_or(F.col("_in").isNull()).alias("unknown"), F.bool_or(F.col("shot").isNull()).alias("no_shot"))
    after = later.groupBy("run").agg(F.count("*").alias("n_later"), F.sort_array(F.collect_list(F.struct("place", F.col("place").cast("string").alias("step"), "message", "summary", "shot"))).alias("post"))
    out = per.join(after, "run", "left").join(differ, "run", "left")
    fault = _first((F.col("differs"), "replay and history differ"), (F.col("unknown"), "a step is not in the run"), (F.col("no_shot"), "a picture is missing"))
    drop = lambda steps: F.transform(steps, lambda s: F.struct(s["step"].alias("step"), s["message"].alias("message"), s["summary"].alias("summary"), s["shot"].alias("shot")))
    whole = F.concat(drop(F.col("prefix")), F.coalesce(drop(F.col("post")), F.array().cast("array<struct<step:string,message:string,summary:string,shot:string>>")))
    return out.select("run", "n_prefix", F.coalesce("n_later", F.lit(0)).alias("n_later"), F.when(fault.isNull(), whole).alias("steps"), fault.alias("fault"))


def final_states(probes: DataFrame, most: int) -> DataFrame:
    """run, line and text of each run's last probe: its outputs by name, then the fingerprint; cut behind ``most`` characters.

    ``probes``: run, line, name, output, fingerprint; a line has a row per output. Runs whose last line says nothing have no row.
    """
    last = probes.groupBy("run").agg(F.max("line").alias("line"))
    rows = probes.join(last, ["run", "line"]).groupBy("run", "line").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", F.rtrim(F.coalesce("output", F.lit(""))).alias("output"))))).alias("o"), F.max("fingerprint").alias("f"))
    parts = F.concat(F.transform("o", lambda x: F.concat(F.lit("["), x["name"], F.lit("]\n"), x["output"])), F.when(F.col("f") != "", F.array(F.concat(F.lit("State fingerprint (sha256): "), "f"))).otherwise(F.array().cast("array<string>")))
    text = F.array_join(parts, "\n")
    out = rows.withColumn("text", text).where("text <> ''")
    return out.select("run", "line", F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit(f"\n... [truncated to {most} characters]"))).otherwise(F.col("text")).alias("text"))
