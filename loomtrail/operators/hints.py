"""Hints for a recovery, what of them shows in its thoughts, and the export of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a hint, and their wording (fixed values).
LEVELS = ["l1_step", "l2_evidence", "l3_state_diff"]
SHOWS = "Step %s was wrong: the screen shows %s = %s, but you used %s (from step %s)."
CHANGED = " Step %s already changed %s.%s (row %s): compensate that first, then redo the step correctly."
UNCHANGED = " Nothing has been written yet: redo the step correctly."


def _filled(text: str, *values: Column) -> Column:
    return F.format_string(text, *(F.coalesce(v.cast("string"), F.lit("None")) for v in values))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def step_hint() -> Column:
    """The first level: which step it was (column root)."""
    return _filled("Step %s was wrong.", F.col("root"))


def evidence_hint() -> Column:
    """The second level: what the screen shows against what was carried (columns root, contradiction, carried)."""
    return _filled(SHOWS, F.col("root"), F.col("contradiction.column"), _quoted(F.col("contradiction.value")), _quoted(F.col("carried.value")), F.col("carried.source_at"))


def state_hint() -> Column:
    """The third level: also what was written already (column affected)."""
    wrote = _filled(CHANGED, F.col("affected.at"), F.col("affected.db"), F.col("affected.tbl"), F.col("affected.rowid"))
    return F.concat(evidence_hint(), F.when(F.col("affected.tbl").isNotNull(), wrote).otherwise(UNCHANGED))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def leaks(hint: Column, thoughts: Column, context: Column, root: Column, written: Column, n: int = 5, patterns: list[str] | None = None) -> Column:
    """What of a hint the thoughts give away, as a list: the step, the table, n-grams in the hint's order, and patterns.

    A table counts if the hint names it, an n-gram if the context (instruction and actions) does not have it as well. Thoughts
    that are null or blank give nothing away.
    """
    said, known = F.lower(thoughts), F.lower(F.coalesce(context, F.lit("")))
    step = F.when(F.regexp_like(said, F.concat(F.lit(r"\bstep\s*#?\s*"), root.cast("string"), F.lit(r"\b"))), F.concat(F.lit("step:"), root.cast("string")))
    table = F.lower(written)
    named = F.regexp_like(said, F.concat(F.lit(r"\b\Q"), table, F.lit(r"\E\b"))) & F.contains(F.lower(hint), table) & ~F.contains(known, table)
    in_said, in_known = (F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")) for c in (said, known))
    own = words(hint)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), " ")))
    shown = F.filter(grams, lambda g: F.contains(in_said, F.concat(F.lit(" "), g, F.lit(" "))) & ~F.contains(in_known, F.concat(F.lit(" "), g, F.lit(" "))))
    shown = F.when(F.size(own) >= n, F.transform(shown, lambda g: F.concat(F.lit("ngram:"), g))).otherwise(F.array().cast("array<string>"))
    found = [F.when(F.regexp_like(said, F.lit("(?i)" + p)), F.lit(f"pattern:{p}")) for p in patterns or []]
    every = F.concat(F.array_compact(F.array(step, F.when(named, F.concat(F.lit("table:"), written)))), shown, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))
    return F.when(F.coalesce(F.trim(thoughts) != "", F.lit(False)), every).otherwise(F.array().cast("array<string>"))


def redacted(thought: Column, leak: Column) -> Column:
    """A thought without the sentences that hold a leak; ``leak`` tells of a sentence (a lambda's argument) whether it does."""
    return F.trim(F.array_join(F.filter(F.split(thought, r"(?<=[.!?\n])\s+"), lambda s: ~leak(s)), " "))


def annotation_export(reviews: DataFrame, flags: DataFrame, criteria: DataFrame, failures: DataFrame) -> DataFrame:
    """A record per run and annotator: the review with its weighted score, or the flag that the run is to be made again.

    ``reviews``: run, annotator, scores (map of criterion to 0 or 1), sha; ``flags``: run, annotator, status, sha; ``criteria``:
    run, criterion, weight; ``failures``: run, annotator, failure. A flag of the same annotator takes a review's place.
    Weights that are no positive finite numbers count 1. ``fault`` names reviews whose scores are missing or are not those of the run's criteria; they have no score.
    """
    key = ["run", "annotator"]
    again = flags.where("status = 'needs_rerun'").groupBy(*key).agg(F.min("sha").alias("sha"))
    weight = F.when(F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight"), F.lit(False)), F.col("weight")).otherwise(1.0)
    per = criteria.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("criterion", weight.alias("weight")))).alias("w"))
    valid = reviews.join(again.select(*key), key, "left_anti").join(per, "run", "left").join(failures.select(*key, "failure"), key, "left")
    names = F.transform("w", lambda x: x["criterion"])
    fault = F.when(F.coalesce(F.size("scores"), F.lit(0)) <= 0, "no scores").when(F.col("w").isNull() | ~F.array_sort(F.map_keys("scores")).eqNullSafe(names), "scores of other criteria")
    score = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["weight"] * F.col("scores")[x["criterion"]]) / F.aggregate("w", F.lit(0.0), lambda a, x: a + x["weight"])
    done = F.forall(F.map_values("scores"), lambda v: v == 1).cast("int")
    fine = fault.isNull()
    rows = valid.select(*key, "sha", F.when(fine, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("score"), F.when(fine, done).alias("solved"), "failure", F.lit("valid").alias("status"), fault.alias("fault"))
    none = lambda t: F.lit(None).cast(t)
    return rows.union(again.select(*key, "sha", none("double"), none("int"), none(dict(failures.dtypes)["failure"]), F.lit("needs_rerun"), none("string")))
