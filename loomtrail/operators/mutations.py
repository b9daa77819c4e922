"""Mutations of values that a task's steps produce, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.facts import date_part

#: Families of values by the first pattern that a type's name matches, and the mutations of each (fixed values).
FAMILIES = [
    ("entity", "ref$|id$|^(person|contact|user|member|order|event|message|file|channel|dm|booking|flight|account|transaction|listing)"),
    ("date", "date|time|stamp|deadline|when|day$"),
    ("amount", "amount|price|total|balance|cost|fee|money|currency|usd|sum$|count$|number|quantity|percent|^(integer|int|float|decimal)$"),
    ("list", "list|rows|set$|items|candidates|\\[\\]|^many|^(report|record|summary|ranking)$"),
    ("boolean", "bool|flag|^is_|allowed|decision|branch"),
    ("text", "text|title|body|name|subject|content|note|message|string|answer|summary"),
]
BY_FAMILY = {
    "entity": ["entity_other", "entity_same_name"],
    "date": ["date_plus_minus_day", "date_plus_minus_week", "time_zone_shift_hour", "date_other_field"],
    "amount": ["amount_pct", "amount_unit", "amount_neighbor_transaction", "amount_omit_fee"],
    "list": ["list_omit_element", "list_extra_element", "list_reorder"],
    "boolean": ["boolean_flip"],
    "text": ["text_stale_version", "text_similar_entity"],
}
#: Tasks per core that nodes are spread over.
TASKS = 8
WRITES = ["write_other_entity", "write_mutated_value", "write_omit", "write_duplicate"]


def family(type_name: Column) -> Column:
    return F.coalesce(*(F.when(F.regexp_like(type_name, F.lit("(?i)" + p)), name) for name, p in FAMILIES), F.lit("text"))


def mutations_of(produced: DataFrame) -> DataFrame:
    """A row per produced value (task, node, place, name, type and more) and mutation of its family."""
    lists = F.create_map(*(x for k, v in BY_FAMILY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return produced.withColumn("mutation", F.explode(F.element_at(lists, family(F.col("type")))))


def static_records(produced: DataFrame, writing: DataFrame, horizons: DataFrame) -> DataFrame:
    """A record per node and distinct mutation: task, node, mutation, mutated_ref, original_ref, and the node's horizon.

    Of several values of a node with one mutation the first counts; ``writing`` (task, node) have the mutations of writes behind them. ``horizons``: task, node and more.
    """
    n = TASKS * produced.sparkSession.sparkContext.defaultParallelism
    # a node's rows meet before they become rows per mutation, so that those are not shuffled
    own = mutations_of(produced.select("task", "node", "place", "name", "type").repartition(n, "task", "node")).select("task", "node", "place", "name", "mutation")
    wrote = writing.select("task", "node").repartition(n, "task", "node").select("task", "node", F.lit(1 << 30).alias("place"), F.lit("<writes>").alias("name"), F.explode(F.array(*map(F.lit, WRITES))).alias("mutation"))
    first = own.unionByName(wrote).groupBy("task", "node", "mutation").agg(F.min(F.struct("place", "name")).alias("first")).select("task", "node", "mutation", "first.name")
    refs = first.select("task", "node", "mutation", F.concat_ws(":", F.lit("static"), "name", "mutation").alias("mutated_ref"), F.when(F.col("name") != "<writes>", F.concat_ws(":", F.lit("derived"), "node", "name")).alias("original_ref"))
    return refs.join(horizons.repartition(n, "task", "node"), ["task", "node"])


def _choice(seed: int, *key: str) -> Column:
    """-1 or 1 by the hash of a key, in the place of a seeded random choice."""
    return F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), *key).cast("binary")), F.lit(2)) * 2 - 1


def _moved(value: Column, days: Column, hours: Column) -> Column:
    """A date, or a date and time with its way of writing kept, moved on."""
    day = F.date_format(F.date_add(F.to_date(F.left(value, F.lit(10))), days.cast("int")), "yyyy-MM-dd")
    at = F.to_timestamp_ntz(F.concat(F.left(value, F.lit(10)), F.lit(" "), F.substring(value, 12, 8)), F.lit("yyyy-MM-dd HH:mm[:ss]"))
    later = F.date_format(at + F.make_interval(hours=hours), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.length(value) == 10, day).when(hours == 0, F.concat(day, F.substring(value, F.lit(11), F.length(value)))).otherwise(later)


def mutated_values(mutations: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``mutated`` to (task, node, name, mutation, table, kind, value) and leaves out what has no other value.

    ``value`` is text; ``kind`` tells what it stands for: text, number (whole or not), boolean, or list (a JSON list of
    texts). ``rows`` (table, id, label) are the rows that ids refer to. Choices follow from hashes: another id is the next one of the
    same label in the order of hashes, in a circle, or for ``entity_other`` and ``write_other_entity`` the one of the least hash in its table that differs.
    """
    key = ["task", "node", "name", "mutation"]
    sign = _choice(seed, *key)
    h = F.crc32(F.concat_ws("|", F.lit(str(seed)), "table", F.col("id").cast("string")).cast("binary"))
    ranked = rows.select("table", F.col("id").cast("string").alias("id"), "label", h.alias("h"))
    order = F.struct("h", "id")
    two = ranked.groupBy("table").agg(F.min_by("id", order).alias("least"))
    second = ranked.join(two, "table").where("id <> least").groupBy("table").agg(F.min_by("id", order).alias("next_least"))
    circle = Window.partitionBy("table", "label").orderBy("h", "id")
    same = ranked.withColumn("other", F.coalesce(F.lead("id").over(circle), F.first("id").over(circle))).where("other <> id").select("table", F.col("id").alias("value"), "other")
    m = mutations.join(two.join(second, "table", "left"), "table", "left").join(same, ["table", "value"], "left")
    other = F.when(F.col("least") != F.col("value"), F.col("least")).otherwise(F.col("next_least"))
    number, dated = F.col("kind") == "number", (F.col("kind") == "text") & date_part(F.col("value")).isNotNull()
    amount = F.expr("try_cast(value AS decimal(30, 6))")
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+\z", "")
    text, many = (F.col("kind") == "text") & (F.col("value") != ""), F.when(F.col("kind") == "list", F.from_json("value", "array<string>"))
    size, zero = F.size(many), F.lit(0)
    is_ = lambda *names: F.col("mutation").isin(*names)
    at = F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), *key).cast("binary")), F.greatest(size, F.lit(1)))
    whole = number & F.col("value").rlike(r"\A-?[0-9]+\z")
    step = lambda k: plain(F.round(amount + k, 6))
    mutated = (
        F.when(is_("entity_other", "write_other_entity") & whole, other).when(is_("entity_same_name") & whole, F.col("other"))
        .when(is_("date_plus_minus_day") & dated, _moved(F.col("value"), sign, zero)).when(is_("date_plus_minus_week") & dated, _moved(F.col("value"), sign * 7, zero))
        .when(is_("time_zone_shift_hour") & dated & F.contains("value", F.lit("T")), _moved(F.col("value"), zero, sign))
        .when(is_("amount_pct") & number, F.regexp_replace(F.round(amount * (1 + sign * F.lit(0.05).cast("decimal(4,2)")), 2).cast("string"), r"\.?0+\z", "")).when(is_("amount_unit") & number, F.when(whole, (amount + sign).cast("long").cast("string")).otherwise(step(sign)))
        .when(is_("list_omit_element") & (size > 1), F.to_json(F.filter(many, lambda x, i: i != at))).when(is_("list_extra_element") & (size > 0), F.to_json(F.concat(many, F.slice(many, 1, 1)))).when(is_("list_reorder") & (size > 1), F.to_json(F.reverse(many)))
        .when(is_("boolean_flip") & (F.col("kind") == "boolean"), F.when(F.col("value") == "true", "false").otherwise("true"))
        .when(is_("text_similar_entity") & text, F.when(F.length("value") > 3, F.expr("left(value, length(value) - 1)")).otherwise(F.concat("value", F.lit("x")))).when(is_("text_stale_version") & (F.col("kind") == "text"), F.concat("value", F.lit(" (old)")))
        .when(is_("write_mutated_value") & text, F.concat("value", F.lit("x"))).when(is_("write_mutated_value") & number, F.when(whole, (amount + 1).cast("long").cast("string")).otherwise(step(F.lit(1))))
    )
    return m.select(*mutations.columns, mutated.alias("mutated")).where("mutated is not null")


def outcomes(mutations: DataFrame, order: DataFrame, results: DataFrame, ends: DataFrame) -> DataFrame:
    """id, caught_by, distance and class of each mutation (id, task, node).

    ``order``: task, node, place; ``results``: id, node, passed; ``ends``: id, error, final_passed, diverged (where the
    state differs from the wanted one). A run that failed counts as caught by the execution; else the first failing check behind the node catches
    it, so many places later; else the final check, else a difference of states, else nothing does.
    """
    upto = F.count("*").over(Window.partitionBy("task").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))  # places up to this one
    counted = order.where("place is not null").select("task", "node", "place", upto.alias("_upto"))
    place = counted.select("task", F.col("node").alias("_n"), F.col("place").alias("_p"), F.col("_upto").alias("_to"))
    failing = results.where("not passed").select("id", F.col("node").alias("_n"))
    own = mutations.join(counted, ["task", "node"]).select("id", "task", "place", "_upto")
    failed = own.join(failing, "id").join(place, ["task", "_n"]).where("_p > place")
    first = failed.groupBy("id").agg(F.min(F.struct("_p", "_n", (F.col("_to") - F.col("_upto")).cast("int").alias("distance"))).alias("f")).select("id", F.col("f._n").alias("node"), "f.distance")
    out = mutations.select("id").join(ends, "id", "left").join(first, "id", "left")
    error, final = F.col("error").isNotNull(), F.col("final_passed") == F.lit(False)
    caught = F.when(error, "execution_error").when(F.col("node").isNotNull(), F.col("node")).when(final, "final").otherwise(F.col("diverged"))
    kind = F.when(error, "verifier_only").when(F.col("node").isNotNull(), F.when(F.col("distance") == 1, "required_next").otherwise("required_later")).when(final | F.col("diverged").isNotNull(), "verifier_only").otherwise("silent")
    return out.select("id", caught.alias("caught_by"), F.when(~error, F.col("distance")).alias("distance"), kind.alias("class"))
