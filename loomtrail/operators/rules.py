"""Rules as data: volatile columns, synonyms, type families, horizon buckets, taxonomies, judges, reversibility."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of columns that change by themselves.
VOLATILE = [
    "^(created|updated|modified|deleted|edited|completed|cancelled|archived)_at$", "^timestamp$", "^last_[a-z_]*(at|time)$", "^(created|updated)_by(_actor_id|_vm_id)?$",
    "^(status_expires_at|dnd_until|send_at)$", "^(world_id|actor_id|vm_id|canonical_id|canonical_key|canonical_[a-z_]+_key)$", "^unread_count$",
]

# Failure types by category, category groups, new names and retired names of types, and the order of categories.
CATEGORIES = {
    "planning": ["fabricate_data", "scope_error", "misunderstand_task_objective"],
    "perception": ["ineffective_action", "progress_misperception", "state_misinterpretation", "detail_misperception"],
    "execution": ["typing_or_parameter_error", "grounding_failure", "incorrect_ui_element"],
    "termination": ["premature_completion", "budget_exhaustion"],
}
GROUPS = {"planning": "long_horizon", "perception": "long_horizon", "execution": "local", "termination": "termination"}
RENAMED = {
    "wrong_subgoal": "misunderstand_task_objective", "hallucinated_data": "fabricate_data", "constraint_loss": "scope_error", "section_content_misplacement": "incorrect_ui_element",
    "wrong_target": "incorrect_ui_element", "lack_of_knowledge": "misunderstand_task_objective", "fail_to_terminate": "budget_exhaustion", "hit_budget_limit": "budget_exhaustion",
}
RETIRED = ["gui_workflow_bypass", "exceed_bash_budget", "insufficient_evidence_granularity"]
PRIORITY = ["planning", "perception", "execution", "termination"]

# Type and confidence of each pattern of evidence.
TYPING = {
    "transcription_error": ("typing_or_parameter_error", 0.9), "wrong_ui_element": ("incorrect_ui_element", 0.8), "wrong_entity_co_displayed": ("misunderstand_task_objective", 0.85),
    "wrong_entity": ("incorrect_ui_element", 0.7), "stale_value_from_earlier_page": ("state_misinterpretation", 0.8), "required_read_never_observed": ("misunderstand_task_objective", 0.6),
    "duplicate_gold_write": ("progress_misperception", 0.8), "hallucinated_value": ("fabricate_data", 0.75), "wrong_value_written": ("typing_or_parameter_error", 0.75),
    "extra_write": ("scope_error", 0.6), "budget_exhausted_no_root_cause": ("budget_exhaustion", 0.95), "premature_completion_claim": ("premature_completion", 0.95),
}

_CATEGORY = {label: category for category, labels in CATEGORIES.items() for label in labels}


def is_volatile(table: Column, column: Column, patterns: list[str] = VOLATILE, kept: dict[str, list[str]] | None = None) -> Column:
    """Whether a cell's column changes by itself; ``kept`` names columns, by table, that count all the same. ``table`` is qualified by its application."""
    hit = reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns))
    spared = reduce(lambda a, b: a | b, ((table == t) & column.isin(cols) for t, cols in (kept or {}).items()), F.lit(False))
    return hit & ~spared


def steady(df: DataFrame, table: str, patterns: list[str] = VOLATILE, kept: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` without its volatile columns; the scan does not read them."""
    return df.drop(*(c for c in df.columns if c not in (kept or {}).get(table, []) and any(re.search(p, c) for p in patterns)))


def tables_left(names: list[str], excluded: list[str], patterns: list[str]) -> list[str]:
    """The tables of a catalog that neither a name nor a pattern excludes."""
    return [n for n in names if n not in excluded and not any(re.search(p, n) for p in patterns)]


def renamed(mapping: Column, synonyms: dict[str, str]) -> Column:
    """A mapping whose old keys have their new names, unless the new key is there already; of two old keys the first counts."""
    def moved(of: Column, old: str, new: str) -> Column:
        return F.map_from_entries(F.transform(F.map_entries(of), lambda e: F.struct(F.when(e["key"] == old, F.lit(new)).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))

    return reduce(lambda of, x: F.when(F.map_contains_key(of, x[0]) & ~F.map_contains_key(of, x[1]), moved(of, *x)).otherwise(of), synonyms.items(), mapping)


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The family of the first pattern that is found in a type's name, whatever the case."""
    return reduce(lambda rest, p: F.when(text.rlike(f"(?i){p[0]}"), p[1]).otherwise(rest), reversed(patterns), F.lit(default))


def horizon_bucket(horizon: Column, buckets: list[str]) -> Column:
    """The label (``2``, ``2-3``, ``>=4``) whose bounds hold a horizon; without one ``verifier_only``, if that is a label, else ``none``."""
    out = F.lit("none")
    for label in reversed([b for b in buckets if b != "verifier_only"]):
        low, dash, high = label.removeprefix(">=").partition("-")
        test = horizon >= int(low) if label.startswith(">=") else horizon.between(int(low), int(high)) if dash else horizon == int(low)
        out = F.when(test, label).otherwise(out)
    return F.when(horizon.isNull(), "verifier_only" if "verifier_only" in buckets else "none").otherwise(out)


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def category_of(label: Column) -> Column:
    return _map(_CATEGORY)[label]


def group_of(label: Column) -> Column:
    return _map(GROUPS)[category_of(label)]


def normal_labels(labels: Column) -> Column:
    """Labels under their present names, each once, without retired ones; an unknown label is an error."""
    now = F.transform(labels, lambda x: F.coalesce(_map(RENAMED)[x], x))
    known = F.filter(now, lambda x: x.isin(list(_CATEGORY)))
    strange = F.filter(now, lambda x: ~x.isin([*_CATEGORY, *RETIRED]))
    return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown label "), strange[0]))).otherwise(F.array_distinct(known))


def primary_label(labels: Column) -> Column:
    """The first label of the first category that has one."""
    def first_of(category: str) -> Column:
        return F.get(F.filter(labels, lambda x: category_of(x) == category), F.lit(0))

    return F.coalesce(*map(first_of, PRIORITY))


def classified(found: DataFrame, typing: dict[str, tuple[str, float]] = TYPING) -> DataFrame:
    """Adds type, category, group and confidence to rows with a ``pattern``.

    Without one the outcome tells: a spent budget, or a claim of success that the final verifier denies (not one that it
    leaves open). Rows that no rule covers get nulls and a confidence of 0.
    """
    claim = F.col("declared_complete") & (F.col("final_verifier") == F.lit(False))
    pattern = F.coalesce(F.col("pattern"), F.when(F.col("budget_exhausted"), "budget_exhausted_no_root_cause").when(claim, "premature_completion_claim"))
    kind = _map({k: t for k, (t, _) in typing.items()})[pattern]
    sure = F.create_map(*(F.lit(x) for k, (_, c) in typing.items() for x in (k, c)))[pattern]
    return found.withColumn("pattern", pattern).withColumn("type", kind).withColumns({"category": category_of(F.col("type")), "group": group_of(F.col("type")), "confidence": F.coalesce(sure, F.lit(0.0))})


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def same_source(judge: Column, agent: Column, groups: dict[str, str]) -> Column:
    """Whether a judge and an agent are one model: equal names, one the end of the other, or one group of names."""
    a, b = plain_name(judge), plain_name(agent)
    of = {re.sub("[^a-z0-9]", "", k.lower()): v for k, v in groups.items()}
    group = _map(of) if of else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return (a == b) | a.endswith(b) | b.endswith(a) | F.coalesce(group[a] == group[b], F.lit(False))


def greatest_class(nodes: DataFrame, run: str, effect_class: str, ranks: list[str]) -> DataFrame:
    """Reversibility of each run: its nodes of each class, and the class of the greatest rank."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(effect_class))
    counts = [F.count_if(F.col(effect_class) == r).alias(r) for r in ranks]
    return nodes.groupBy(run).agg(*counts, F.max(rank).alias("_r")).withColumn("greatest", F.get(F.array(*map(F.lit, ranks)), F.col("_r").cast("int") - 1)).drop("_r")


def before_first(nodes: DataFrame, run: str, at: str, counted: Column, stop: Column) -> DataFrame:
    """How many counted nodes stand before a run's first ``stop`` node; null for a run without one. Two aggregations, no window."""
    first = nodes.where(stop).groupBy(run).agg(F.min(at).alias("_first"))
    early = nodes.where(counted).join(first, run).where(F.col(at) < F.col("_first")).groupBy(run).agg(F.count("*").alias("n_before"))
    return nodes.select(run).distinct().join(first, run, "left").join(early, run, "left").select(run, F.when(F.col("_first").isNotNull(), F.coalesce("n_before", F.lit(0))).alias("n_before"))
