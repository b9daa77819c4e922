"""Operators over the ordered steps of a run: carried values, depth grids, neutral segments, ledgers, first choices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(steps: DataFrame, by: str, at: str, value: Column, name: str) -> DataFrame:
    """The last non-null value before each step."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn(name, F.last(value, ignorenulls=True).over(w))


def within(steps: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """Number of a step within its group, from 0."""
    return steps.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1)


def depth_cases(runs: DataFrame, root: str, last: str, explicit: str, depths: list[int]) -> DataFrame:
    """A row per run and depth: whether a case can be cut there, and if not, why."""
    out = runs.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("cut", F.col(root) + F.col("depth"))
    reason = F.when(F.col(explicit).isNull(), "no_explicit_error").when(F.col("cut") > F.col(last), "beyond_end").when(F.col("cut") > F.col(explicit), "beyond_explicit_error")
    return out.withColumn("reason", F.coalesce(reason, F.lit("eligible")))


def prefixes(steps: DataFrame, cases: DataFrame, by: str, at: str, order: str) -> DataFrame:
    """Steps up to the cut of each eligible case, numbered anew."""
    hit = steps.join(cases.where("reason = 'eligible'").select(by, "depth", "cut"), by).where(F.col(at) <= F.col("cut"))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy(by, "depth").orderBy(order)) - 1)


def root_cause(candidates: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The strongest candidate of each run."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def pick(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return root_cause(rows.withColumn("_k", F.struct(*by)), "_k", order).drop("_k")


def ledger(steps: DataFrame, by: str, at: str, fact: str, value: str, gold: DataFrame, used: DataFrame) -> DataFrame:
    """First sighting of each fact, kept if the fact is a gold one or its value is used in a later step."""
    first = steps.withColumn("_r", F.row_number().over(Window.partitionBy(by, fact).orderBy(at))).where("_r = 1").drop("_r")
    return first.join(gold.select(by, fact).distinct(), [by, fact], "left_semi").unionByName(first.join(used.select(by, at).distinct(), [by, at], "left_semi")).distinct()


def neutral_segments(steps: DataFrame, by: str, at: str, key: str, value: str, page: str, feeds: DataFrame | None = None) -> DataFrame:
    """Greedy longest stretches of a run after which every key has the value it had before and the page is the same.

    ``feeds`` (run, at, used) names later steps that use what a step typed: a stretch that feeds a step behind it does not
    count. States are hashes over all keys, kept up by windows, so that only numbers of a run meet in a task; there each
    step is held against the steps with its state and page, last ones first.
    """
    run = Window.partitionBy(by).orderBy(at)
    was = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(by, key).orderBy(at))
    cell = lambda v: F.xxhash64(F.col(key).cast("string"), v.cast("string"))
    moved = cell(F.col(value)).bitwiseXOR(F.coalesce(cell(was["v"]), F.lit(0).cast("long")))
    moved = F.when(was.isNull(), cell(F.col(value))).otherwise(moved)
    state = F.expr("bit_xor(_m)").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = steps.select(by, F.col(at), F.xxhash64(page).alias("_page"), moved.alias("_m")).withColumn("_state", state)
    rows = rows.select(by, F.col(at), "_state", "_page", F.coalesce(F.lag("_state").over(run), F.lit(0).cast("long")).alias("_before"), F.coalesce(F.lag("_page").over(run), F.col("_page")).alias("_page_before"))
    if feeds is None:
        rows = rows.withColumn("_used", F.lit(None).cast("long"))
    else:
        rows = rows.join(feeds.groupBy(by, at).agg(F.max("used").cast("long").alias("_used")), [by, at], "left")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        ats, after, before, used = pdf[at].tolist(), list(zip(pdf["_state"], pdf["_page"], strict=True)), list(zip(pdf["_before"], pdf["_page_before"], strict=True)), pdf["_used"].fillna(-1).tolist()
        places: dict[tuple, list[int]] = {}
        for j, k in enumerate(after):
            places.setdefault(k, []).append(j)
        out, i = [], 0
        while i < len(ats):
            best = next((j for j in reversed(places.get(before[i], [])) if j >= i and max(used[i : j + 1]) <= ats[j]), None) if places.get(before[i], [-1])[-1] >= i else None
            if best is not None:
                out.append((pdf[by].iloc[0], ats[i], ats[best], best - i + 1))
            i = i + 1 if best is None else best + 1
        return pd.DataFrame(out, columns=[by, "first", "last", "n_steps"])

    kinds = dict(steps.dtypes)
    return rows.groupBy(by).applyInPandas(each, f"{by} {kinds[by]}, first {kinds[at]}, last {kinds[at]}, n_steps long")


def token_matched(rows: DataFrame, by: str, tokens: str, target: str, tolerance: float, order: Column) -> DataFrame:
    """Greedy choice of rows per group, in a fixed random order, whose tokens come within ``tolerance`` of the target; rows that would overshoot are skipped.

    The running total is carried in order, so a group's ids and sizes, not its texts, pass through one task.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, total = None, 0
        for pdf in batches:
            keep = []
            for g, n, goal in zip(pdf[by], pdf[tokens], pdf[target], strict=True):
                if g != group:
                    group, total = g, 0
                fits = total < goal * (1 - tolerance) and total + n <= goal * (1 + tolerance)
                total += n if fits else 0
                keep.append(fits)
            yield pdf[keep]

    sorted_ = rows.withColumn("_o", order).repartition(by).sortWithinPartitions(by, "_o").drop("_o")
    return sorted_.mapInPandas(each, sorted_.schema)
