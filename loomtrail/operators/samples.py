"""Training records from runs: what was read and carried on, evidence of an error, and samples cut at steps.

Tables: ``steps`` (run, at, thought, action, kind), ``params`` (run, at, place, name, value), ``facts`` (run, at, place,
source, table, column, entity, value), ``deltas`` (run, at, seq, db, tbl, rowid, op), ``analysis`` (run, root, evidence,
wrong_value, gold_value, gold_entity, wrong_entity). A record holds its run's history, so a run's steps meet in one row;
everything else is joined and aggregated by keys within the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.facts import date_part, normal_text

#: Sizes of the pieces by which values are looked up in texts: the longest that a value has is used.
PIECES = [12, 6, 3, 1]
#: Pieces of a run's values that its parameters are held against before they are cut into rows; those of a run with more are all cut.
HELD = 256
#: Kinds of a step that ends a run, and the texts of records (fixed values).
ENDS = ["done", "fail"]
SHOWN = "The current observation shows {} = {}, but I carried {} (from step {}){}."
WROTE = "; step {} already wrote {}.{}:{}"
UNCHECKED = "About to perform an irreversible action; the value it uses came from step {} and has not been re-checked since."
ACTION_KINDS = {"parameter": "redo_node_with_gold_values", "omission": "execute_skipped_node", "state": "compensate_writes_then_redo_node"}


def _filled(text: str, *values: Column) -> Column:
    """A text with its {} filled in."""
    parts = text.split("{}")
    return F.concat(*(x for k, p in enumerate(parts) for x in ((F.lit(p), values[k]) if k < len(values) else (F.lit(p),))))


def last_used(values: DataFrame, params: DataFrame) -> DataFrame:
    """run, value, last_at: the last step of the run with a parameter that contains the value, or its day, whatever the case.

    Values and parameters meet by pieces: the first 12, 6, 3 or 1 characters of a value, and all pieces of that size of a parameter. Of a
    run with ``HELD`` different pieces of values at most, only those pieces of a parameter become rows that are among them.
    """
    plain = normal_text(F.col("value"))
    v = values.select("run", "value").distinct()
    pats = v.select("run", "value", F.explode(F.array_distinct(F.array_compact(F.array(F.lower(plain), date_part(F.col("value")))))).alias("pat")).where("pat <> ''")
    size = F.coalesce(*(F.when(F.length("pat") >= n, n) for n in PIECES))
    pats = pats.withColumn("size", size).withColumn("piece", F.expr("left(pat, size)"))
    texts = params.where("value is not null").groupBy("run", F.lower("value").alias("text")).agg(F.max("at").alias("at"))
    pieces = F.flatten(F.array(*(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)) for n in PIECES)))
    asked = pats.select("run", "piece").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("piece"))).where(F.col("_n") <= HELD + 1)
    asked = asked.groupBy("run").agg(F.collect_list("piece").alias("asked"))
    kept = F.when(F.size("asked") <= HELD, F.array_intersect(pieces, "asked")).otherwise(pieces)
    cut = texts.join(asked, "run").select("run", "text", "at", F.explode(kept).alias("piece"))
    met = pats.join(cut, ["run", "piece"]).where(F.contains("text", F.col("pat")))
    return met.groupBy("run", "value").agg(F.max("at").alias("last_at"))


def ledger(facts: DataFrame, params: DataFrame, gold: DataFrame, least: int) -> DataFrame:
    """The first reading of each cell that is a gold one (run, table, column, entity) or whose value is used in a later step.

    Gives run, at, place, name, value, source_ref. Values of fewer than ``least`` characters are left out.
    """
    cell = ["run", "table", "column", "entity"]
    read = facts.where(F.length("value") >= least)
    both = read.join(last_used(read, params), ["run", "value"], "left").join(gold.select(*cell).distinct().withColumn("gold", F.lit(True)), cell, "left")
    first = both.where("gold or last_at > at").groupBy(*cell).agg(F.min(F.struct("at", "place", "value", "source")).alias("f"))
    return first.select("run", "f.at", "f.place", F.format_string("%s.%s@%s", "table", "column", "entity").alias("name"), "f.value", F.format_string("obs:%d:%s", "f.at", F.coalesce("f.source", F.lit("gui"))).alias("source_ref"))


def evidence(cuts: DataFrame, analysis: DataFrame, carried: DataFrame, facts: DataFrame, params: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds contradiction, carried, affected and verified to ``cuts`` (run, cut, known_to); ``carried`` is a ledger.

    The contradiction is the first reading at the evidence step that shows the gold or the wrong entity, or a value whose
    first ten characters the gold value contains. Carried is the last ledger entry up to ``known_to`` with the wrong value, else
    the last parameter of the root step with it. Affected is the first write from the root to the cut. A record is verified if it has both of the first two.
    """
    a = analysis.select("run", "root", "evidence", "wrong_value", "gold_value", "gold_entity", "wrong_entity")
    wrong = normal_text(F.col("wrong_value"))
    shown = facts.join(a, "run").where(F.col("at") == F.col("evidence")).where(F.coalesce(F.col("entity") == F.col("gold_entity"), F.lit(False)) | F.coalesce(F.col("entity") == F.col("wrong_entity"), F.lit(False)) | F.coalesce(F.contains("gold_value", F.left(F.coalesce("value", F.lit("")), F.lit(10))), F.lit(False)))
    shown = shown.groupBy("run").agg(F.min_by(F.struct("table", "column", "entity", "value", "at"), "place").alias("contradiction"))
    entry = F.struct("name", "value", F.col("at").alias("source_at"), "source_ref")
    same = carried.join(a, "run").where(normal_text(F.col("value")) == wrong).select("run", "at", "place", entry.alias("entry"))
    of_cut = cuts.join(same, "run").where("at <= known_to").groupBy("run", "cut").agg(F.max_by("entry", F.struct("at", "place")).alias("_entry"))
    given = params.join(a, "run").where((F.col("at") == F.col("root")) & (normal_text(F.col("value")) == wrong))
    param = F.struct(F.concat(F.lit("param:"), "name").alias("name"), "value", F.col("at").alias("source_at"), F.concat(F.lit("param:"), F.col("at").cast("string")).alias("source_ref"))
    given = given.groupBy("run").agg(F.max_by(param, "place").alias("_param"))
    wrote = deltas.join(a, "run").where("at >= root").groupBy("run").agg(F.min(F.struct("at", "seq", "db", "tbl", "rowid", "op")).alias("_write"))
    out = cuts.join(shown, "run", "left").join(of_cut, ["run", "cut"], "left").join(given, "run", "left").join(wrote, "run", "left")
    out = out.withColumns({"carried": F.coalesce("_entry", "_param"), "affected": F.when(F.col("_write.at") <= F.col("cut"), F.col("_write"))}).drop("_entry", "_param", "_write")
    return out.withColumn("verified", F.col("contradiction").isNotNull() & F.col("carried").isNotNull())


def history(steps: DataFrame, fields: list[str]) -> DataFrame:
    """run, history: a run's steps in order, each with ``fields`` and a reference to what was seen."""
    step = F.struct("at", *fields, F.concat(F.lit("obs:"), F.col("at").cast("string")).alias("observation_ref"))
    return steps.groupBy("run").agg(F.sort_array(F.collect_list(step)).alias("history"))


def with_inputs(cuts: DataFrame, steps: DataFrame, carried: DataFrame, upto: bool = False, fields: tuple[str, ...] = ("thought", "action")) -> DataFrame:
    """Adds history (the steps before the cut, or also the cut's own) and entries (the ledger up to ``known_to``) to ``cuts``."""
    entries = carried.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "place", "name", "value", "source_ref"))).alias("entries"))
    out = cuts.join(history(steps, list(fields)), "run", "left").join(entries, "run", "left")
    before = F.filter("history", lambda s: (s["at"] <= F.col("cut")) if upto else (s["at"] < F.col("cut")))
    return out.withColumns({"history": before, "entries": F.coalesce(F.filter("entries", lambda e: e["at"] <= F.col("known_to")), F.array().cast(dict(entries.dtypes)["entries"]))})


def detection_samples(steps: DataFrame, analysis: DataFrame, carried: DataFrame, facts: DataFrame, params: DataFrame, deltas: DataFrame, offsets: list[int]) -> DataFrame:
    """Samples in which an error shows: a cut per offset behind the evidence step, up to the run's last step, if verified.

    Gives sample_id, run, cut, check, thought, history, entries, contradiction, carried, affected.
    """
    last = steps.groupBy("run").agg(F.max("at").alias("last"))
    a = analysis.where("root is not null and evidence is not null")
    cuts = a.join(last, "run").select("run", "last", F.explode(F.transform(F.array(*map(F.lit, offsets)), lambda o: F.col("evidence") + o)).alias("cut")).where("cut <= last")
    cuts = cuts.select("run", "cut", (F.col("cut") - 1).alias("known_to"))
    found = evidence(cuts, a, carried, facts, params, deltas).where("verified")
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    wrote = F.when(F.col("affected").isNotNull(), _filled(WROTE, *(F.col(f"affected.{c}").cast("string") for c in ("at", "db", "tbl", "rowid")))).otherwise("")
    thought = _filled(SHOWN, F.col("contradiction.column"), quoted(F.col("contradiction.value")), quoted(F.col("carried.value")), F.col("carried.source_at").cast("string"), wrote)
    out = with_inputs(found, steps, carried)
    return out.select(F.format_string("%s_detection_%d", F.col("run").cast("string"), "cut").alias("sample_id"), "run", "cut", F.lit("inconsistent").alias("check"), thought.alias("thought"), "history", "entries", "contradiction", "carried", "affected")


def recovery_cases(steps: DataFrame, analysis: DataFrame, carried: DataFrame, facts: DataFrame, params: DataFrame, deltas: DataFrame, split: DataFrame, depths: list[int]) -> DataFrame:
    """A case per run of the training split (run, split) and depth behind its root, up to the run's last step, with its evidence; thoughts are left out of the history."""
    last = steps.groupBy("run").agg(F.max("at").alias("last"))
    a = analysis.where("root is not null").join(split.where("split = 'train'").select("run"), "run", "left_semi")
    cuts = a.join(last, "run").select("run", "root", "last", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn("cut", F.col("root") + F.col("depth")).where("cut <= last")
    found = evidence(cuts.select("run", "depth", "cut", F.col("cut").alias("known_to")), a, carried, facts, params, deltas)
    out = with_inputs(found, steps, carried, upto=True, fields=("action",))
    return out.select(F.format_string("%s_d%d", F.col("run").cast("string"), "depth").alias("sample_id"), "run", "depth", "cut", "history", "contradiction", "carried", "affected", "verified")


def verification_samples(steps: DataFrame, analysis: DataFrame, deltas: DataFrame, eligible: DataFrame, guarded: DataFrame) -> DataFrame:
    """Where a run with a censored horizon first writes, behind its root, to a guarded table (run, table); ``eligible`` lists the runs with a step that only the end shows.

    Gives sample_id, run, cut, thought. ``analysis`` has censored.
    """
    a = analysis.where("censored and root is not null").join(eligible.select("run").distinct(), "run", "left_semi").select("run", "root")
    wrote = deltas.select("run", "at", F.concat_ws(".", "db", "tbl").alias("table")).join(guarded.select("run", "table").distinct(), ["run", "table"], "left_semi")
    first = a.join(wrote, "run").where("at > root").groupBy("run", "root").agg(F.min("at").alias("cut"))
    return first.select(F.format_string("%s_verification_%d", F.col("run").cast("string"), "cut").alias("sample_id"), "run", "cut", _filled(UNCHECKED, F.col("root").cast("string")).alias("thought"))


def gold_actions(analysis: DataFrame, nodes: DataFrame, values: DataFrame, writes: DataFrame) -> DataFrame:
    """What to do at the root: run, node, kind, app, op, parameters, gold_writes, continue_with.

    ``analysis``: run, node, detector; ``nodes``: run, node, place, app, op; ``values``: run, node, name, value; ``writes``:
    run, node, place and the cells of a write. A run without a node gives none; an unknown detector redoes the node; of values of one name the greatest counts.
    """
    a = analysis.where("node is not null").select("run", "node", "detector")
    cells = [c for c in writes.columns if c not in ("run", "node", "place")]
    once = values.groupBy("run", "node", "name").agg(F.max("value").alias("value"))
    v = a.join(once, ["run", "node"]).groupBy("run", "node").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("parameters"))
    w = a.join(writes, ["run", "node"]).groupBy("run", "node").agg(F.sort_array(F.collect_list(F.struct("place", *cells))).alias("gold_writes"))
    own = a.join(nodes, ["run", "node"]).select("run", F.col("place").alias("_p"))
    after = own.join(nodes.select("run", F.col("node").alias("_n"), "place"), "run").where("place > _p").groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "_n"))), lambda s: s["_n"]).alias("continue_with"))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ACTION_KINDS.items() for x in kv)), F.coalesce("detector", F.lit("parameter"))), F.lit(ACTION_KINDS["parameter"]))
    out = a.join(nodes.select("run", "node", "app", "op"), ["run", "node"], "left").join(v, ["run", "node"], "left").join(w, ["run", "node"], "left").join(after, "run", "left")
    return out.select("run", "node", kind.alias("kind"), "app", "op", "parameters", "gold_writes", F.coalesce("continue_with", F.array().cast("array<string>")).alias("continue_with"))


def accepted_attempts(attempts: DataFrame, levels: list[str], policy: str) -> DataFrame:
    """The attempt that a case's recovery is taken from: case, level, teacher, attempt, n_attempts.

    ``attempts``: case, level, teacher, attempt, verified, leaked. They are made in the order of ``levels``, those of the
    case's own policy before those of an external teacher, and end with the first one taken: the first verified one
    (``off``, ``redact``), the first verified one without a leak (``resample``), or that, unless an earlier verified one leaked (``drop``).
    """
    order = F.struct((F.col("teacher") != "self").alias("t"), F.array_position(F.array(*map(F.lit, levels)), F.col("level")).alias("l"), "attempt")
    rows = attempts.where(F.col("level").isin(levels)).withColumn("_n", F.row_number().over(Window.partitionBy("case").orderBy(order)))
    leaked = F.coalesce("leaked", F.lit(False)) if policy in ("resample", "drop") else F.lit(False)
    good = rows.where("verified").where(~leaked if policy == "resample" else F.lit(True)).withColumn("_l", leaked)
    best = good.groupBy("case").agg(F.min(F.struct("_n", "level", "teacher", "attempt", "_l")).alias("b")).where("not b._l")
    return best.select("case", "b.level", "b.teacher", "b.attempt", F.col("b._n").alias("n_attempts"))
