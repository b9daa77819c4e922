"""Checks of stored records: verdicts that are fresh, calls and their results, labels and proposals, budgets, gates, horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.graphs import path_lengths
from loomtrail.operators.rules import horizon_bucket, is_volatile

#: Positions of a step by which later readers are looked for.
SPAN = 4096


def fresh_verdicts(tasks: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """The stored verdict of each task (task, text) by ``model`` on this very text (task, model, digest, verdict); null if there is none."""
    digest = tasks.select("task", F.sha2("text", 256).alias("digest"))
    own = verdicts.where(F.col("model") == model).groupBy("task", "digest").agg(F.any_value("verdict").alias("verdict"))
    return digest.join(own, ["task", "digest"], "left").select("task", "verdict")


def judge_coverage(units: DataFrame, verdicts: DataFrame, cell: list[str], unit: str) -> DataFrame:
    """Units of each cell, how many are judged, and the models that judged them."""
    by = verdicts.groupBy(unit).agg(F.collect_set("model").alias("_m"))
    out = units.join(by, unit, "left").groupBy(*cell).agg(F.count("*").alias("n"), F.count("_m").alias("n_judged"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_m", F.array().cast("array<string>")))))).alias("models"))
    return out.withColumn("models", F.array_join("models", ","))


def matched_results(calls: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Calls with the content of their result; ``state`` is matched, missing, or conflict if results of one call differ."""
    one = results.groupBy(*key).agg(F.countDistinct("content").alias("_n"), F.min("content").alias("_c"))
    out = calls.join(one, key, "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "conflict").otherwise("matched")
    return out.withColumn("state", state).withColumn("content", F.when(F.col("state") == "matched", F.col("_c"))).drop("_n", "_c")


def in_turn(lines: DataFrame, turns: DataFrame, run: str) -> DataFrame:
    """The turn that holds each line: turns (run, turn, calls) take so many lines each, one behind the other.

    Lines and starts of turns are put in one order, and each line takes over the last start before it, so there is no
    join of every line with every turn.
    """
    w = Window.partitionBy(run).orderBy("turn")
    start = turns.where("calls > 0").select(run, "turn", (F.sum("calls").over(w) - F.col("calls")).alias("line"), "calls")
    both = start.select(run, "line", "turn", (F.col("line") + F.col("calls")).alias("stop")).unionByName(lines.select(run, "line", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("stop")))
    held = both.withColumn("_k", F.struct("turn", "stop")).withColumn("_k", F.when(F.col("turn").isNotNull(), F.col("_k")))
    held = held.withColumn("_k", F.last("_k", ignorenulls=True).over(Window.partitionBy(run).orderBy("line", F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return held.where("turn is null").select(run, "line", F.when(F.col("line") < F.col("_k.stop"), F.col("_k.turn")).alias("turn"))


def picked_proposals(wanted: DataFrame, proposals: DataFrame) -> DataFrame:
    """For each (run, annotator) the annotator's own proposal, else the only one of the run, else null."""
    own = proposals.select("run", F.col("reviewer").alias("annotator"), F.col("proposal").alias("_own"))
    only = proposals.groupBy("run").agg(F.when(F.count("*") == 1, F.min("proposal")).alias("_only"))
    return wanted.join(own, ["run", "annotator"], "left").join(only, "run", "left").select("run", "annotator", F.coalesce("_own", "_only").alias("proposal"))


def repair_roots(annotations: DataFrame, adjudications: DataFrame, runs: DataFrame) -> DataFrame:
    """The root of each run (run, sha): adjudicated, else the one that all annotations of this very run name, else null."""
    settled = adjudications.join(runs, ["run", "sha"], "left_semi").groupBy("run").agg(F.min("root").alias("_a"))
    single = annotations.join(runs, ["run", "sha"], "left_semi").groupBy("run").agg(F.when(F.countDistinct("root") == 1, F.min("root")).alias("_s"))
    return runs.join(settled, "run", "left").join(single, "run", "left").select("run", F.coalesce("_a", "_s").alias("root"))


def single_matches(wanted: DataFrame, files: DataFrame, key: str, digest: str) -> DataFrame:
    """The file with the digest that is wanted, if exactly one has it; else why not."""
    n = files.groupBy(digest).agg(F.count("*").alias("_n"), F.min("path").alias("_p"))
    out = wanted.join(n, digest, "left")
    return out.select(key, F.when(F.col("_n") == 1, F.col("_p")).alias("path"), F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "several").alias("fault"))


def over_budget(contexts: DataFrame, by: list[str], tokens: str, budget: int) -> DataFrame:
    """The largest context of each group, how many are beyond the budget, and whether the group is left out for it."""
    return contexts.groupBy(*by).agg(F.max(tokens).alias("largest"), F.count_if(F.col(tokens) > budget).alias("n_over"), F.count("*").alias("n")).withColumn("excluded", F.col("n_over") > 0)


def time_probes(expected: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Variables whose first ten characters are not those of the cell that they name."""
    both = expected.join(cells.withColumnRenamed("value", "_v"), key, "left")
    return both.where(~F.substring("value", 1, 10).eqNullSafe(F.substring("_v", 1, 10))).select(*key, "value", F.col("_v").alias("found"))


def several_builds(members: DataFrame, run: str, build: str) -> DataFrame:
    """Runs that more than one build holds."""
    return members.groupBy(run).agg(F.countDistinct(build).alias("n_builds")).where("n_builds > 1")


def problems(*sources: DataFrame) -> DataFrame:
    """All problems (task, kind, text) of each task, in order, and their number."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    return both.groupBy("task").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "text"))), "; ").alias("problems"))


def steady_image(image: Column, table: str) -> Column:
    """A row image (a mapping) without its volatile cells."""
    return F.map_filter(image, lambda k, _: ~is_volatile(F.lit(table), k))


def resolved_names(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Applications (app) of spellings (alias), whatever the case; null for a spelling that is not known."""
    a = aliases.select(F.lower("alias").alias("_n"), "app").distinct()
    return rows.withColumn("_n", F.lower(F.trim(name))).join(a, "_n", "left").drop("_n")


def clamped(x: Column, y: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> tuple[Column, Column]:
    """A point of one frame in another one, half to even, within its bounds."""
    def axis(v: Column, of: Column, to: Column) -> Column:
        return F.least(F.greatest(F.bround(v * to / of).cast("long"), F.lit(0)), to - 1)

    return axis(x, width, to_width), axis(y, height, to_height)


def gate(checks: DataFrame, by: str, required: list[str]) -> DataFrame:
    """Whether a release has all the checks that are required (name, passed), each passed every time, and which are not."""
    each = checks.where(F.col("name").isin(required)).groupBy(by, "name").agg(F.every("passed").alias("ok"))
    good = each.groupBy(by).agg(F.collect_set(F.when(F.col("ok"), F.col("name"))).alias("_g"))
    open_ = F.array_except(F.array(*map(F.lit, required)), F.col("_g"))
    return checks.select(by).distinct().join(good, by, "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<string>"))).select(by, (F.size(open_) == 0).alias("released"), F.array_join(open_, ",").alias("open"))


def contract_breaches(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Records that break a rule, with the names of those that they break; a rule without a value is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select(key, F.array_join(broken, ",").alias("broken")).where("broken <> ''")


def latent_horizons(nodes: DataFrame, edges: DataFrame, reads: DataFrame, writes: DataFrame, checked: DataFrame) -> DataFrame:
    """How long what a node gets wrong stays unseen, from the graph alone.

    ``nodes``: node, position, app; ``edges``: source, target; ``reads`` and ``writes``: node, table, column, entity, where
    an entity ending in :* stands for all. A node contaminates what it reads and writes and what its descendants write; the
    first later node that reads any of it sees it, over as many edges as the shortest way has, or else places between. If none
    does, it is seen by a verifier if a node of its lineage has one (``checked``: node), else not at all.
    """
    ways = path_lengths(edges, "source", "target").toDF("node", "_r", "_l")
    reach = ways.select("node", F.col("_r").alias("other"))
    lineage = reach.unionByName(nodes.select("node", F.col("node").alias("other")))
    dirty = reads.unionByName(lineage.join(writes.withColumnRenamed("node", "other"), "other").select("node", "table", "column", "entity")).distinct()
    first = _first_readers(dirty, reads, nodes.select("node", "position", "app"))
    out = nodes.join(first, "node", "left").withColumn("_r", F.col("w.reader")).join(ways, ["node", "_r"], "left")
    out = out.join(lineage.join(checked.select(F.col("node").alias("other")).distinct(), "other").select("node").distinct().withColumn("_c", F.lit(True)), "node", "left")
    horizon = F.when(F.col("w").isNotNull(), F.coalesce("_l", F.col("w.at") - F.col("position")))
    kind = F.when(horizon == 1, "required_next").when(horizon.isNotNull(), "required_later").when(F.col("_c"), "verifier_only").otherwise("silent")
    return out.select("node", "position", "app", F.col("_r").alias("visible"), horizon.alias("horizon"), kind.alias("observability"), F.coalesce(F.col("w.reader_app") != F.col("app"), F.lit(False)).alias("cross_app"))


def _first_readers(dirty: DataFrame, reads: DataFrame, place: DataFrame) -> DataFrame:
    """(node, w): at, reader and reader_app of the first later reader whose facts meet the node's: equal entities or a wildcard on either side.

    Only the next reader behind each position is looked for, in steps of ``SPAN`` positions and then among the steps, so
    neither pairs nor large groups arise.
    """
    star = F.col("entity").endswith(":*")
    way = lambda kind, entity: F.struct(F.lit(kind).alias("kind"), entity.alias("entity"))
    equal = way("equal", F.col("entity"))
    key = ["table", "column", "kind", "entity"]

    def keyed(rows: DataFrame, always: str, starred: str) -> DataFrame:
        """Rows under each key by which they meet others; a fact without a place, table or column meets none."""
        ways = F.array_compact(F.array(F.when(F.col("entity").isNotNull(), equal), way(always, F.lit("")), F.when(star, way(starred, F.lit("")))))
        own = rows.join(place, "node").where("position is not null and table is not null and column is not null")
        return own.withColumn("_k", F.explode(ways)).select("table", "column", "_k.kind", "_k.entity", "position", F.floor(F.col("position") / SPAN).alias("step"), "node", "app")

    asked = keyed(dirty, "starred_reader", "starred_node")
    readers = keyed(reads, "starred_node", "starred_reader")
    w = F.struct(F.col("position").alias("at"), F.col("node").alias("reader"), F.col("app").alias("reader_app"))
    at = readers.groupBy(*key, "step", "position").agg(F.min(w).alias("w"))
    ask = asked.select(*key, "step", "position").distinct().withColumn("w", F.lit(None).cast(at.schema["w"].dataType))
    rows = ask.withColumn("_ask", F.lit(1)).union(at.withColumn("_ask", F.lit(0)))
    behind = Window.partitionBy(*key, "step").orderBy(F.desc("position"), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.min("w").over(behind)).where("_ask = 1").select(*key, "step", "position", "near")
    steps = rows.groupBy(*key, "step").agg(F.min("w").alias("w"))
    far = steps.withColumn("far", F.min("w").over(Window.partitionBy(*key).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))).drop("w")
    found = near.join(far, [*key, "step"]).select(*key, "position", F.coalesce("near", "far").alias("w")).where("w is not null")
    return asked.join(found, [*key, "position"]).groupBy("node").agg(F.min("w").alias("w"))


def profile(horizons: DataFrame, graph: str, buckets: list[str], targets: list[str]) -> DataFrame:
    """Per graph how many nodes are of each kind, greatest and median horizon, the most frequent bucket (of equal ones the greatest label) and how many nodes lie in the targets."""
    h = horizons.withColumn("bucket", horizon_bucket(F.col("horizon"), buckets))
    kinds = ["required_next", "required_later", "verifier_only", "silent"]
    out = h.groupBy(graph).agg(F.count("*").alias("n_nodes"), *(F.count_if(F.col("observability") == k).alias(k) for k in kinds), F.count_if("cross_app").alias("cross_app"), F.max("horizon").alias("longest"), F.median("horizon").alias("median"),
        F.bround(F.count_if(F.col("cross_app") | (F.col("observability") == "verifier_only")) / F.count("*"), 4).alias("hidden_share"), F.count_if(F.col("bucket").isin(targets)).alias("in_target"))
    mode = h.groupBy(graph, "bucket").agg(F.count("*").alias("_n")).groupBy(graph).agg(F.max(F.struct("_n", "bucket"))["bucket"].alias("bucket"))
    return out.join(mode, graph)
