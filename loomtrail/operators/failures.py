"""Where a run leaves its expected lineage: candidates by state, by typed text and by omission, the root cause and its type.

Tables are long. A change is (run, at, seq, op, table, entity, column, value), with one row per cell and a column ``*`` for
a DELETE; an expected cell (run, table, entity, column, value, old_value, ord); a sighting (run, at, table, entity). All
detectors are equi-joins on the run and a cell, an entity or a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.facts import date_part, normal_text
from loomtrail.operators.rules import VOLATILE, classified, is_volatile

CELL = ["run", "table", "entity", "column"]
ROW = ["run", "at", "seq"]
# The order of detectors and how sure each pattern is.
DETECTED = {
    "duplicate_gold_write": (0, 0.8), "wrong_value_written": (0, 0.85), "wrong_entity_co_displayed": (0, 0.9), "wrong_entity": (0, 0.9), "extra_write": (0, 0.6),
    "transcription_error": (1, 0.9), "stale_value_from_earlier_page": (1, 0.75), "hallucinated_value": (1, 0.75), "required_read_never_observed": (2, 0.5),
}
#: Candidates of less confidence are never a root cause (fixed value).
THRESHOLD = 0.7


def _evidence(*names: str):
    return F.concat_ws(".", *names).alias("evidence")


def state_candidates(changes: DataFrame, expected: DataFrame, sightings: DataFrame, volatile: list[str] = VOLATILE) -> DataFrame:
    """Changed rows that are not as expected.

    A row of an expected entity is held against its cells: another value, or the value a second time. A row of an
    unknown entity may be an expected insert (its table's first template whose shared cells agree), or the write of a
    value that another entity should have (for an UPDATE also of a column that another one should have), or extra.
    """
    c = changes.withColumn("value", normal_text(F.col("value")))
    e = expected.withColumn("value", normal_text(F.col("value"))).where(~is_volatile(F.col("table"), F.col("column"), volatile))
    cells = c.join(e.select(*CELL, F.col("value").alias("want")).withColumn("known", F.lit(True)), CELL)
    same = F.col("want").eqNullSafe(F.col("value"))
    nth = F.sum(same.cast("int")).over(Window.partitionBy(*CELL).orderBy("at", "seq"))
    own = cells.withColumn("nth", nth).withColumn("pattern", F.when(~same, "wrong_value_written").when(F.col("nth") > 1, "duplicate_gold_write"))
    own = own.where("pattern is not null").select("run", "at", "seq", "pattern", _evidence("table", "entity", "column"))

    entities = e.groupBy("run", "table", "entity").agg(F.min("ord").alias("ord"), F.every(F.col("old_value").isNull()).alias("insert"))
    strange = c.join(entities.select("run", "table", "entity"), ["run", "table", "entity"], "left_anti")
    rows = strange.select(*ROW, "op", "table", "entity").distinct()
    inserts = entities.where("insert").select("run", "table", F.col("entity").alias("template"), "ord")
    wanted = e.join(inserts.withColumnRenamed("template", "entity").drop("ord"), ["run", "table", "entity"], "left_semi").select("run", "table", F.col("entity").alias("template"), "column", F.col("value").alias("want"))
    differ = strange.join(wanted, ["run", "table", "column"]).where(~F.col("want").eqNullSafe(F.col("value"))).select(*ROW, "template").distinct()
    fits = rows.join(inserts, ["run", "table"]).join(differ, [*ROW, "template"], "left_anti").groupBy(*ROW, "table").agg(F.min_by("template", F.struct("ord", "template")).alias("template"))
    nth = F.row_number().over(Window.partitionBy("run", "table", "template").orderBy("at", "seq"))
    again = fits.withColumn("nth", nth).where("nth > 1").select(*ROW, F.lit("duplicate_gold_write").alias("pattern"), _evidence("table", "template"))

    left = strange.join(fits.select(*ROW), ROW, "left_anti").where(~is_volatile(F.col("table"), F.col("column"), volatile))
    meant = e.groupBy("run", "table", "column", "value").agg(F.min_by("entity", F.struct("ord", "entity")).alias("by_value"))
    other = e.where("old_value is not null").groupBy("run", "table", "column").agg(F.min_by("entity", F.struct("ord", "entity")).alias("by_column"))
    hit = left.join(meant, ["run", "table", "column", "value"], "left").join(other, ["run", "table", "column"], "left")
    hit = hit.withColumn("meant", F.coalesce("by_value", F.when(F.col("op") == "UPDATE", F.col("by_column"))))
    row = hit.groupBy(*ROW, "table", "entity").agg(F.min(F.when(F.col("meant").isNotNull(), F.struct("column", "meant"))).alias("m"))
    first = sightings.groupBy("run", "table", "entity").agg(F.min("at").alias("seen"))
    row = row.select(*ROW, "table", "entity", F.col("m.column").alias("column"), F.col("m.meant").alias("meant"))
    row = row.join(first.withColumnRenamed("seen", "seen_own"), ["run", "table", "entity"], "left").join(first.select("run", "table", F.col("entity").alias("meant"), F.col("seen").alias("seen_meant")), ["run", "table", "meant"], "left")
    both = F.coalesce((F.col("seen_own") < F.col("at")) & (F.col("seen_meant") < F.col("at")), F.lit(False))
    pattern = F.when(F.col("meant").isNull(), "extra_write").when(both, "wrong_entity_co_displayed").otherwise("wrong_entity")
    return own.unionByName(again).unionByName(row.select(*ROW, pattern.alias("pattern"), _evidence("table", "entity", "column")))


def text_candidates(params: DataFrame, expected: DataFrame, values_seen: DataFrame, most: int = 2) -> DataFrame:
    """Typed texts (run, at, text) that are no expected value (run, ord, value), but nearly one or another date.

    A text within ``most`` edits of a value of four characters or more is mistyped. A date that no expected value has is
    stale if the run has seen it before (run, at, value), else made up. Texts of fewer than three characters are left out.
    """
    p = params.select("run", "at", F.trim("text").alias("text")).where(F.length("text") >= 3)
    g = expected.select("run", "ord", "value", normal_text(F.col("value")).alias("_same"))
    p = p.withColumn("_same", normal_text(F.col("text"))).join(g.select("run", "_same").distinct(), ["run", "_same"], "left_anti")
    near = p.join(g.where(F.length("value") >= 4), "run").withColumn("d", F.levenshtein(F.lower("text"), F.lower("value"), most)).where("d >= 0")
    typo = near.groupBy("run", "at", "text").agg(F.min_by("value", F.struct("d", "ord")).alias("evidence"))
    typo = typo.select("run", "at", "text", F.lit("transcription_error").alias("pattern"), "evidence")
    day = F.get(F.filter(F.transform(F.split(F.replace("text", F.lit(","), F.lit(" ")), r"\s+"), date_part), lambda x: x.isNotNull()), F.lit(0))
    dated = p.join(typo, ["run", "at", "text"], "left_anti").withColumn("day", day).where("day is not null")
    days = g.withColumn("day", date_part(F.col("value"))).where("day is not null")
    dated = dated.join(days.groupBy("run").agg(F.min_by("day", "ord").alias("evidence")), "run").join(days.select("run", "day").distinct(), ["run", "day"], "left_anti")
    seen = values_seen.select("run", date_part(F.col("value")).alias("day"), F.col("at").alias("seen")).where("day is not null").groupBy("run", "day").agg(F.min("seen").alias("seen"))
    stale = F.coalesce(F.col("seen") < F.col("at"), F.lit(False))
    dated = dated.join(seen, ["run", "day"], "left").select("run", "at", "text", F.when(stale, "stale_value_from_earlier_page").otherwise("hallucinated_value").alias("pattern"), "evidence")
    return typo.unionByName(dated)


def omission_candidates(changes: DataFrame, required: DataFrame, sightings: DataFrame) -> DataFrame:
    """Changes whose required entity (run, table, need) was not sighted before; one per change and need."""
    first = sightings.groupBy("run", "entity").agg(F.min("at").alias("seen"))
    w = changes.select("run", "at", "table").distinct().join(required, ["run", "table"])
    late = w.join(first.select("run", F.col("entity").alias("need"), "seen"), ["run", "need"], "left").where("seen is null or seen > at")
    return late.groupBy("run", "at").agg(F.min("need").alias("evidence")).select("run", "at", F.lit("required_read_never_observed").alias("pattern"), "evidence")


def root_causes(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The strong candidate of each run that comes first: by action, then by detector, then the surest."""
    known = F.create_map(*(x for k, (place, sure) in DETECTED.items() for x in (F.lit(k), F.struct(F.lit(place).alias("place"), F.lit(-sure).alias("unsure")))))
    strong = candidates.withColumn("_k", known[F.col("pattern")]).where(F.col("_k.unsure") <= -threshold)
    first = strong.groupBy("run").agg(F.min(F.struct("at", "_k.place", "_k.unsure", "pattern", "evidence")).alias("k"), F.count("*").alias("n_candidates"))
    return first.select("run", F.col("k.at").alias("at"), F.col("k.pattern").alias("pattern"), F.col("k.evidence").alias("evidence"), "n_candidates")


def records(candidates: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per failed run of ``outcomes`` (run, final_verifier, declared_complete, budget_exhausted) with its root cause and type.

    A run failed if its final verifier says so; one that the verifier leaves open did not.
    """
    failed = outcomes.where("final_verifier = false")
    out = classified(failed.join(root_causes(candidates, threshold), "run", "left"))
    return out.select("run", "at", "pattern", "evidence", "type", "category", "group", "confidence", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))


def horizon(found: DataFrame, last: DataFrame, sightings: DataFrame) -> DataFrame:
    """Actions from the root to the first later sighting of what it touched; censored at the run's end."""
    seen = sightings.select("run", F.col("at").alias("later"), "entity")
    near = found.withColumn("entity", F.element_at(F.split("evidence", "[.]"), 2)).join(seen, ["run", "entity"]).where("later > at").groupBy("run").agg(F.min("later").alias("identifiable"))
    return found.join(near, "run", "left").join(last, "run").select("run", "at", "identifiable", (F.coalesce("identifiable", "last") - F.col("at")).alias("horizon"), F.col("identifiable").isNull().alias("censored"))
