"""Scores of judged runs: weighted rubric, pass-at-k, awareness by depth and type, distributions and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rubric_verdict(criteria: DataFrame, run: str, weight: str, success: Column) -> DataFrame:
    """Share of the weight that is satisfied, and whether all criteria are, per run; a weight that is not positive is an error."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    return criteria.groupBy(run).agg(
        F.count("*").alias("n_criteria"),
        F.sum(F.when(success, w).otherwise(0.0)).alias("gained"), F.sum(w).alias("total"), F.bool_and(success).alias("passed"),
    ).withColumn("score", F.col("gained") / F.col("total"))


def pass_at_k(units: DataFrame, runs: DataFrame, unit: str, k: int, missing_fails: bool = True) -> DataFrame:
    """Per unit: solved in its first k runs, and the score of the first passing run, else the best score, else 0.

    ``runs`` has unit, run (from 1), passed and score. Units without runs score 0, or are left out if missing_fails is False.
    """
    first = runs.where(F.col("run") <= k)
    per = first.groupBy(unit).agg(
        F.count("*").alias("n_runs"), F.bool_or("passed").alias("solved"),
        F.coalesce(F.min_by("score", F.when(F.col("passed"), F.col("run"))), F.max("score")).alias("score"),
    )
    out = units.select(unit).join(per, unit, "left" if missing_fails else "inner")
    return out.select(unit, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("solved", F.lit(False)).alias("solved"), F.coalesce("score", F.lit(0.0)).alias("score"))


def awareness_table(units: DataFrame, unit: str, depth: str, labels: str, aware: str) -> DataFrame:
    """Units, judged units and aware units by depth and label; label ALL counts a unit once, depth is null over all depths."""
    def counts(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n_units"), F.count(aware).alias("n_judged"), F.count_if(F.col(aware)).alias("n_aware"))

    each = units.select(unit, depth, F.explode(F.array_distinct(labels)).alias("label"), aware)
    whole = counts(units.groupingSets([[F.col(depth)], []], F.col(depth))).withColumn("label", F.lit("ALL"))
    typed = counts(each.groupingSets([[F.col(depth), F.col("label")], [F.col("label")]], F.col(depth), F.col("label")))
    names = [depth, "label", "n_units", "n_judged", "n_aware"]
    both = whole.select(names).unionByName(typed.select(names))
    return both.withColumn("rate_judged", F.try_divide("n_aware", "n_judged")).withColumn("rate_all", F.try_divide("n_aware", "n_units"))


def any_of_repeats(runs: DataFrame, unit: list[str], flag: str) -> DataFrame:
    """One row per unit, true if any repeat is."""
    return runs.groupBy(*unit).agg(F.bool_or(flag).alias(flag), F.count("*").alias("n_repeats"))


def episode_metrics(episodes: DataFrame, by: str, valid: Column, values: dict[str, Column]) -> DataFrame:
    """Counts, share of invalid episodes and means over the valid ones."""
    return episodes.groupBy(by).agg(
        F.count("*").alias("n_episodes"), F.count_if(valid).alias("n_valid"), (F.count_if(~valid) / F.count("*")).alias("invalid_rate"),
        *(F.avg(F.when(valid, v.cast("double"))).alias(f"mean_{k}") for k, v in values.items()),
    )


def distribution(rows: DataFrame, key: str, taxonomy: DataFrame) -> DataFrame:
    """Count and share of each key of ``taxonomy`` (key), also of those without rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = taxonomy.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = rows.agg(F.count("*").alias("total"))
    return out.crossJoin(total).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("total"))).drop("total")  # one row on the right


def rank_pivot(criteria: DataFrame, run: str, order: list[str], weight: str, success: Column, most: int) -> DataFrame:
    """One row per run with the flags R1, R2, ... of its first criteria, what it gained, and that in percent with two places."""
    ranked = criteria.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(*order))).withColumn("_s", success)
    flags = [F.max(F.when(F.col("_r") == i, F.col("_s").cast("int"))).alias(f"R{i}") for i in range(1, most + 1)]
    out = ranked.groupBy(run).agg(*flags, F.sum(F.when(F.col("_s"), F.col(weight)).otherwise(0)).alias("gained"), F.sum(weight).alias("total"))
    return out.withColumn("percent", F.round(100 * F.col("gained") / F.col("total"), 2))


def mean_and_perfect(rows: DataFrame, percent: str) -> DataFrame:
    """Mean percent over all runs, and the share of runs with 100."""
    return rows.agg(F.count("*").alias("n_runs"), F.round(F.avg(percent), 6).alias("mean"), (F.count_if(F.col(percent) == 100) / F.count("*")).alias("perfect_share"))


def balance_weights(rows: DataFrame, label: str, least: float) -> DataFrame:
    """Weight of each class: rows / (classes * its rows) with four places, at least ``least``."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    all_ = n.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return n.crossJoin(all_).select(label, "n", F.greatest(F.lit(least), F.round(F.col("total") / (F.col("classes") * F.col("n")), 4)).alias("weight"))


def disagreement(reviews: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key the number of distinct values of each field, and the fields on which reviewers differ."""
    seen = reviews.groupBy(key).agg(*(F.countDistinct(f).alias(f"n_{f}") for f in fields))
    return seen.withColumn("differs", F.concat_ws(",", *(F.when(F.col(f"n_{f}") > 1, F.lit(f)) for f in fields)))


def rejection_rate(outcomes: DataFrame, by: str, caught: Column, failed: Column) -> DataFrame:
    """Share of mutations caught, where runs that failed are left out, count as caught, or count as missed."""
    return outcomes.groupBy(by).agg(
        F.count("*").alias("n"), F.try_divide(F.count_if(caught & ~failed), F.count_if(~failed)).alias("rate_exclude"),
        (F.count_if(caught | failed) / F.count("*")).alias("rate_caught"), (F.count_if(caught & ~failed) / F.count("*")).alias("rate_missed"),
    )


def primary_mode(rows: DataFrame, by: str, kind: Column, share: float) -> DataFrame:
    """Two-way counts and the kind that holds at least ``share`` of the rows, else mixed."""
    n = rows.groupBy(by).agg(F.count_if(kind).alias("n_first"), F.count_if(~kind).alias("n_second"))
    whole = F.col("n_first") + F.col("n_second")
    return n.withColumn("main", F.when(F.col("n_first") >= share * whole, "first").when(F.col("n_second") >= share * whole, "second").otherwise("mixed"))


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median (the mean of the middle two), and quartiles by index into the sorted values.

    Values are counted first, and the counts are summed up in the order of the values, so that a group's window holds
    its different values only.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    upto = n.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy(value)))
    of = upto.join(n.groupBy(by).agg(F.sum("_n").alias("_all")), by)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    out = of.groupBy(by).agg(at(F.floor((F.col("_all") - 1) / 2)).alias("_a"), *(at(F.floor(F.col("_all") * i / 4)).alias(f"q{i}") for i in (1, 2, 3)))
    return out.select(by, ((F.col("_a") + F.col("q2")) / 2).alias("median"), "q1", "q2", "q3")


def style(texts: DataFrame, by: str, text: str, names: str) -> DataFrame:
    """Words of texts at a quarter, half and three quarters of their order, the share written in the first person, and names (a pattern) per text."""
    rows = texts.select(by, F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).alias("_w"), text)
    share = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.count_if(F.col(text).rlike(r"\b(I|my|me)\b")) / F.count("*"), 2).alias("first_person"), F.round(F.sum(F.regexp_count(text, F.lit(names))) / F.count("*"), 2).alias("mentions"))
    return share.join(quartiles(rows, by, "_w").select(by, F.col("q1").alias("p25"), F.col("q2").alias("median"), F.col("q3").alias("p75")), by)
