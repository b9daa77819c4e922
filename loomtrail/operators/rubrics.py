"""Criteria of tasks: what they expect, what matches it, how far they are covered, and what follows from that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an amount, an e-mail address, a quotation, a place to fill in and a date, and the date formats in order.
AMOUNT = r"\$\s?([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
QUOTED = '["“]([^"”]{3,80})["”]'
TEMPLATE = "<[^<>]{1,40}>"
DATE = r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}(?:/\d{4})?)\b"
FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d", "MMM d", "M/d/yyyy", "M/d"]
TOLERANCE, CENT = 0.005, 0.005


def iso_date(text: Column, year: int) -> Column:
    """The ISO date of a text in one of ``FORMATS``; one without a year is in ``year``. Null if none fits."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(text, F.lit("Sept"), F.lit("Sep")), F.lit("."), F.lit("")), r"(\d)(st|nd|rd|th)", "$1"), r"\s+", " "))
    tries = []
    for form in FORMATS:
        dated = "yyyy" in form
        tries.append(F.try_to_timestamp(plain if dated else F.concat(plain, F.lit(f" {year}")), F.lit(form if dated else f"{form} yyyy")))
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def filled(value: Column, today: Column) -> Column:
    """``${TODAY}`` and ``${TODAY+3}`` of a variable's value as dates; up to four of them."""
    def once(v: Column) -> Column:
        found = F.regexp_extract(v, r"(\$\{TODAY([+-]\d+)?\})", 1)
        days = F.coalesce(F.try_to_number(F.regexp_extract(v, r"\$\{TODAY\+?(-?\d+)?\}", 1), F.lit("S99999")), F.lit(0)).cast("int")
        return F.when(found != "", F.replace(v, found, F.date_format(F.date_add(today, days), "yyyy-MM-dd"))).otherwise(v)

    return reduce(lambda v, _: once(v), range(4), value)


def _kinds(text: Column, year: int) -> Column:
    def struct(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))

    dates = F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE), 1), lambda x: iso_date(x, year)), lambda x: x.isNotNull())
    quotes = F.transform(F.filter(F.regexp_extract_all(text, F.lit(QUOTED), 1), lambda x: ~x.rlike(TEMPLATE)), F.trim)
    amounts, emails = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), 1), amount), F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 0), F.lower)
    return F.concat(*(F.transform(v, struct(k)) for k, v in (("date", dates), ("amount", amounts), ("email", emails), ("text", quotes))))


def expected_values(criteria: DataFrame, by: str, place: str, weight: str, text: str, year: int, variables: DataFrame | None = None) -> DataFrame:
    """Dates, amounts, addresses, quotations and variables (by, name, value) that criteria name: each once, with the greatest weight, of equal ones the first."""
    found = criteria.select(by, place, weight, F.explode(_kinds(F.col(text), year)).alias("e")).select(by, place, weight, "e.kind", "e.value")
    if variables is not None:
        v = variables.where((F.length("value") >= 4) & F.col("value").rlike(r"[0-9A-Z@ ]")).select(by, "value")
        named = criteria.join(v, by).where(F.contains(F.lower(text), F.lower("value")))
        found = found.unionByName(named.select(by, place, weight, F.lit("variable").alias("kind"), "value"))
    best = found.groupBy(by, "kind", "value").agg(F.max_by(F.struct(place, weight), F.struct(F.col(weight), -F.col(place))).alias("b"))
    return best.select(by, "kind", "value", f"b.{place}", f"b.{weight}")


def matches(kind: Column, want: Column, value: Column) -> Column:
    """Whether a value as text meets an expectation: dates as such or within a text, amounts within half a cent or 0.5 percent, else texts in one another."""
    number, other = want.try_cast("double"), value.try_cast("double")
    close = F.abs(other - number) <= F.greatest(F.abs(number) * TOLERANCE, F.lit(CENT))
    inside = F.exists(F.regexp_extract_all(value, F.lit(AMOUNT), 1), lambda a: F.abs(amount(a) - number) <= CENT)
    low = F.lower(want)
    text = (low == F.lower(value)) | ((F.length(want) >= 4) & F.contains(F.lower(value), low))
    return F.coalesce(F.when(kind == "date", F.contains(value, want)).when(kind == "amount", F.when(other.isNotNull(), close).otherwise(inside)).otherwise(text), F.lit(False))


def met(expectations: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """Expectations with ``met``: whether any value of the same task (by, value) meets them."""
    hit = expectations.join(values.select(by, F.col("value").alias("_v")), by).where(matches(F.col("kind"), F.col("value"), F.col("_v"))).select(by, "kind", "value").distinct()
    return expectations.join(hit.withColumn("met", F.lit(True)), [by, "kind", "value"], "left").withColumn("met", F.coalesce("met", F.lit(False)))


def satisfied_share(criteria: DataFrame, by: str, weight: str, satisfied: Column) -> DataFrame:
    """Share of the weight that is satisfied, or of the criteria if no weight counts; rounded to four places."""
    total = F.sum(weight)
    share = F.when(total != 0, F.sum(F.when(satisfied, F.col(weight)).otherwise(0.0)) / total).otherwise(F.count_if(satisfied) / F.count("*"))
    return criteria.groupBy(by).agg(F.bround(share, 4).alias("share"))


def verdicts(expectations: DataFrame, by: str, share: DataFrame, least: int, match: float, lexical: float) -> DataFrame:
    """A verdict per task of ``share`` (by, share) and why: enough expectations that are met, else enough words covered, else a review."""
    n = expectations.groupBy(by).agg(F.count("*").alias("n"), F.count_if("met").alias("n_met"))
    out = share.join(n, by, "left").fillna(0, ["n", "n_met"])
    good = (F.col("n") >= least) & (F.col("n_met") >= match * F.col("n"))
    code = F.when(good, "expectations_met").when(F.col("n") >= least, "expectations_missed").when(F.col("share") >= lexical, "words_covered").otherwise("words_missed")
    return out.withColumn("code", code).withColumn("verdict", F.when(F.col("code").isin("expectations_met", "words_covered"), "auto_validated").otherwise("needs_review"))


def accepted_share(rows: DataFrame, verdict: str, code: str, gate: float) -> DataFrame:
    """Rows by verdict and code, each with the share of accepted ones over all rows and whether that passes the gate."""
    total = rows.agg((F.count_if(F.col(verdict) == "auto_validated") / F.count("*")).alias("accepted"))
    return rows.groupBy(verdict, code).agg(F.count("*").alias("n")).crossJoin(total).withColumn("passes", F.col("accepted") >= gate)  # one row on the right


def human_score(scores: DataFrame, by: str, weight: str, score: str) -> DataFrame:
    """Weighted mean of scores between 0 and 1, where a weight that is no positive number counts 1; and whether all are 1."""
    w, s = F.col(weight).try_cast("double"), F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    w = F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w).otherwise(1.0)
    return scores.groupBy(by).agg((F.sum(w * s) / F.sum(w)).alias("score"), F.every(s == 1.0).alias("all_pass"))


def flat_values(c: Column) -> Column:
    """All scalars of a JSON text, in their order, as texts: of objects the values, of lists the members, to any depth."""
    strings = r'"(?:[^"\\]|\\.)*"'
    plain = F.regexp_replace(c, rf"{strings}\s*:", "")  # keys
    found = F.regexp_extract_all(plain, F.lit(rf"({strings}|-?[0-9][0-9.eE+-]*|true|false)"), 1)
    return F.transform(found, lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]")).otherwise(v))


def without_keys(c: Column, private: list[str]) -> Column:
    """A JSON text of an object without private keys whose values are texts, numbers or flags, at any depth."""
    names, value = "|".join(private), r'(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)'
    pair = rf'"(?:{names})"\s*:\s*{value}'
    return F.regexp_replace(F.regexp_replace(c, rf",\s*{pair}", ""), rf"{pair}\s*,?\s*", "")


def hidden_values(values: DataFrame, by: str, value: str, public: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Values of a task that none of its public texts shows; such that are shorter than ``least`` are left out."""
    v = values.where(F.length(value) >= least).select(by, value).distinct()
    shown = v.join(public.select(by, F.lower(text).alias("_t")), by).where(F.contains(F.col("_t"), F.lower(value))).select(by, value)
    return v.join(shown.distinct(), [by, value], "left_anti")


def spellings(c: Column) -> Column:
    """How a literal may be written: as it is, in lower case, a whole number without fraction or with commas, an ISO date in three ways."""
    number = F.when(c.rlike("[0-9]"), c.try_cast("double"))  # a text without a digit is no whole number; to find that out by a cast costs an exception
    whole = F.when(number == F.floor(number), F.array(F.floor(number).cast("string"), F.format_number(number, 0)))
    day = F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)), F.lit("yyyy-MM-dd"))
    dates = F.when(day.isNotNull(), F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMMM d"), F.date_format(day, "MMM d")))
    return F.array_distinct(F.concat(F.array(c, F.lower(c)), F.coalesce(whole, F.array().cast("array<string>")), F.coalesce(dates, F.array().cast("array<string>"))))


def literal_allowed(c: Column, text: Column) -> Column:
    """Whether any spelling of a literal occurs in a text, whatever the case."""
    plain = F.contains(F.lower(text), F.lower(c))  # without a digit there is no other spelling
    return F.coalesce(F.when(plain, True).when(~c.rlike("[0-9]"), False).otherwise(F.exists(spellings(c), lambda s: F.contains(F.lower(text), F.lower(s)))), F.lit(False))
