"""Facts (one cell per row) and joins over them: wildcards, first sightings, contradictions, nearest texts, as-of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, table: str, key: str, columns: list[str]) -> DataFrame:
    """table, column, entity and value of each cell; nulls are kept."""
    text = df.select(F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("entity"), *(F.col(c).cast("string").alias(c) for c in columns))
    return text.unpivot(["entity"], columns, "column", "value").select(F.lit(table).alias("table"), "column", "entity", "value")


def wildcard_join(left: DataFrame, right: DataFrame, on: list[str], entity: str) -> DataFrame:
    """Pairs that agree on ``on`` and on the entity, where an entity ending in :* stands for all.

    Three equi-joins (equal entities, wildcard on the left, wildcard on the right) keep hash joins possible.
    """
    a, b = left.withColumnRenamed(entity, "entity_a"), right.withColumnRenamed(entity, "entity_b")
    star_a, star_b = a.where(F.col("entity_a").endswith(":*")), b.where(F.col("entity_b").endswith(":*"))
    equal = a.join(b.withColumn("entity_a", F.col("entity_b")), [*on, "entity_a"])
    names = [*on, "entity_a", "entity_b"]
    any_a = star_a.join(b, on).where("entity_a <> entity_b")
    any_b = a.where(~F.col("entity_a").endswith(":*")).join(star_b, on)
    return equal.select(names).unionByName(any_a.select(names)).unionByName(any_b.select(names))


def seen_before(steps: DataFrame, sightings: DataFrame, by: str, entity: str, at: str) -> DataFrame:
    """Marks steps whose entity was seen strictly earlier in the same run: a first sighting per entity and an equi-join."""
    first = sightings.groupBy(by, entity).agg(F.min(at).alias("first_seen"))
    return steps.join(first, [by, entity], "left").withColumn("seen", F.coalesce(F.col("first_seen") < F.col(at), F.lit(False)))


def first_contradiction(expected: DataFrame, sightings: DataFrame, key: list[str], value: str, at: str, after: str) -> DataFrame:
    """For each expected value the first later sighting of the same cell with another value; null if there is none."""
    e = expected.select(*key, F.col(value).alias("_want"), after)
    hit = sightings.join(e, key).where((F.col(at) > F.col(after)) & (F.col(value) != F.col("_want")))
    first = hit.groupBy(*key).agg(F.min(at).alias("contradicted_at"))
    return expected.select(*key, after).join(first, key, "left")


def never_seen(wanted: DataFrame, sightings: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(sightings.select(*key).distinct(), key, "left_anti")


def _near_texts(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs (left, right, distance) of distinct texts within ``most`` edits; both tables have one column.

    Two texts within d edits, cut into d + 1 pieces, share a piece at places that differ by d at most. The join is on
    the hash of a piece and its place, over rows without texts; these come back once a pair is known to share a piece.
    """
    n = F.length("t")
    a, b = (df.toDF("t").select(F.xxhash64("t").alias("h"), "t") for df in (left, right))
    size = F.greatest(F.ceil(n / (most + 1)), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(F.substring(F.col("t"), k * size + 1, size).alias("piece"), (k * size).alias("at")))
    own = a.select(F.col("h").alias("hl"), n.alias("nl"), F.explode(pieces).alias("p")).select("hl", "nl", F.xxhash64("p.piece").alias("k"), F.explode(F.sequence(F.col("p.at") - most, F.col("p.at") + most)).alias("at"))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.greatest(F.ceil((n + d) / (most + 1)), F.lit(1)).cast("int")))
    whole = b.select(F.col("h").alias("hr"), "t", F.explode(sizes).alias("s")).select("hr", F.length("t").alias("nr"), "t", "s", F.explode(F.sequence(F.lit(0), F.length("t"))).alias("at"))
    other = whole.select("hr", "nr", F.xxhash64(F.substring(F.col("t"), F.col("at") + 1, F.col("s"))).alias("k"), "at").distinct()
    pairs = own.join(other, ["k", "at"]).where(F.abs(F.col("nl") - F.col("nr")) <= most).select("hl", "hr").distinct()
    texts = pairs.join(a.toDF("hl", "left"), "hl").join(b.toDF("hr", "right"), "hr")
    return texts.select("left", "right", F.levenshtein("left", "right", most).alias("distance")).where("distance >= 0")


def nearest_text(left: DataFrame, right: DataFrame, text: str, ident: str, most: int) -> DataFrame:
    """For each left text the nearest right text within ``most`` edits, and how many there are; a row is not its own neighbour.

    Rows with equal texts are first reduced to their number and their two least ids, so that copies make no pairs.
    """
    r = right.select(F.col(text).alias("right"), F.col(ident).alias("i")).where("right is not null")
    some = r.groupBy("right").agg(F.min("i").alias("i1"), F.count("*").alias("n"))
    second = r.join(some, "right").where("i <> i1").groupBy("right").agg(F.min("i").alias("i2"))
    near = _near_texts(left.select(text).where(F.col(text).isNotNull()).distinct(), some.select("right"), most).join(some.join(second, "right", "left"), "right")
    rows = left.select(F.col(ident).alias("left_id"), F.col(text).alias("left")).join(r.select(F.col("i").alias("left_id"), F.col("right").alias("own")), "left_id", "left")
    both = rows.join(near, "left").withColumn("right_id", F.when(F.col("i1") == F.col("left_id"), F.col("i2")).otherwise(F.col("i1"))).where("right_id is not null")
    best = both.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("b"), F.sum(F.col("n") - F.col("right").eqNullSafe(F.col("own")).cast("int")).cast("long").alias("n_near"))
    return best.select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.distance").cast("long").alias("distance"), "n_near")


def as_of(rows: DataFrame, by: str, at: str, kept: Column) -> DataFrame:
    """The place, among the rows that are kept, of the last kept row at or before each row; null before the first."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(kept.cast("int")).over(w)
    return rows.withColumn("place", F.when(n > 0, n - 1))


def used_later(rows: DataFrame, by: str, at: str, value: str, text: str) -> DataFrame:
    """Values that occur in a later text of the same run, with the first place where they do."""
    a = rows.select(by, F.col(at).alias("at"), F.lower(value).alias("value")).where(F.length("value") > 0)
    b = rows.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lower(text).alias("_text"))
    return a.join(b, (F.col(by) == F.col("_by")) & (F.col("_at") > F.col("at")) & F.contains(F.col("_text"), F.col("value"))).groupBy(by, "at").agg(F.min("_at").alias("used_at"))


def first_template(rows: DataFrame, templates: DataFrame, table: str, row_id: str, template_id: str, cell: str, value: str) -> DataFrame:
    """The first template of a row's table whose shared cells all agree; rows and templates are long (one cell per row).

    Rows with the same cells, and templates with the same cells, are held against each other once.
    """
    def kinds(df: DataFrame, ident: str, name: str) -> DataFrame:
        return df.groupBy(table, F.col(ident).alias("_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(cell).alias("c"), F.col(value).alias("v")))).alias(name))

    def long(df: DataFrame, name: str, v: str) -> DataFrame:
        return df.select(table, name, F.explode(name).alias("e")).select(table, name, F.col("e.c").alias("c"), F.col("e.v").alias(v))

    row = kinds(rows, row_id, "_row")
    first = kinds(templates, template_id, "_template").groupBy(table, "_template").agg(F.min("_id").alias(template_id))
    a, b = long(row.select(table, "_row").distinct(), "_row", "v"), long(first, "_template", "w")
    same = a.join(b, [table, "c"]).groupBy(table, "_row", "_template").agg(F.every(F.col("v").eqNullSafe(F.col("w"))).alias("same")).where("same")
    best = same.join(first, [table, "_template"]).groupBy(table, "_row").agg(F.min(template_id).alias(template_id))
    return row.join(best, [table, "_row"]).select(F.col("_id").alias(row_id), template_id)


def normal_text(c: Column) -> Column:
    """Trimmed, white space collapsed; an ISO time as date, T and seconds, without fraction and zone."""
    plain = F.trim(F.regexp_replace(c, r"\s+", " "))
    # fixed value: what counts as an ISO time
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    seconds = F.regexp_extract(plain, iso, 3)
    return F.when(plain.rlike(iso), F.concat(F.regexp_extract(plain, iso, 1), F.lit("T"), F.regexp_extract(plain, iso, 2), F.when(seconds == "", ":00").otherwise(seconds))).otherwise(plain)


def date_part(c: Column) -> Column:
    found = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})([T ]|\s*$)", 1)
    return F.when(found != "", found)


def values_match(a: Column, b: Column, rule: str) -> Column:
    """Equality of normalised values by ``rule``: exact, date or contains."""
    if rule == "date":
        return F.coalesce(date_part(a) == date_part(b), F.lit(False))
    if rule == "contains":
        return F.coalesce(F.contains(F.lower(normal_text(a)), F.lower(normal_text(b))), F.lit(False))
    return normal_text(a).eqNullSafe(normal_text(b))
