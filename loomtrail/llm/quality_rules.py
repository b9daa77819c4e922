"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than space and U+0009-U+000D. Null and empty texts have no words, fail the base
rule and are rejected. Rows are judged one by one: repeated rows and ids get equal results, other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SOLID = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"

# Frequent function words of the languages the rules serve.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with on are be by this from at or an have not which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}

#: (name, ratio, least, most): a document is kept if every ratio lies within its bounds.
THRESHOLDS = [
    ("words", "n_words", 50, 1_000_000),
    ("word_length", "word_chars / n_words", 2.0, 12.0),
    ("symbols_per_word", "n_symbols / n_words", 0.0, 0.1),
    ("stop_words_per_word", "n_stop_words / n_words", 0.02, 0.9),
    ("stop_word_kinds", "n_stop_kinds", 2, 1_000),
    ("repeated_lines", "n_dup_lines / n_lines", 0.0, 0.3),
    ("repeated_words", "n_repeat_words / n_words", 0.0, 0.5),
]


def settled(c: Column) -> Column:
    """The same value, which the optimizer does not move: a filter on it would otherwise repeat all counts below it, once per use."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def repeat_words(words: str) -> dict[str, Column]:
    """Steps that lead to ``__q_n_repeat_words``: the words that lie in a 3-word window found twice or more in the same text.

    Windows are hashed to 64 bits and sorted with their places, so equal ones become neighbours; the places of equal
    neighbours, in order, then say how many words they cover.
    """
    w, n = F.col(words), F.size(words)
    windows = F.when(n >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")),
    )))
    s, m = F.col("__q_windows"), F.greatest(F.size("__q_windows") - 1, F.lit(0))
    same = F.filter(
        F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull(),
    )
    p, k = F.col("__q_places"), F.greatest(F.size("__q_places") - 1, F.lit(0))
    gaps = F.zip_with(F.slice(p, F.lit(1), k), F.slice(p, F.lit(2), k), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)
    return {"__q_windows": windows, "__q_places": F.sort_array(F.array_distinct(F.flatten(same))), "__q_n_repeat_words": settled(F.when(F.size("__q_places") > 0, covered).otherwise(0).cast("long"))}


#: Columns that ``measure`` adds, behind ``PREFIX``.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_stop_kinds", "n_lines", "n_dup_lines", "n_repeat_words"]
PREFIX = "__q_"


def measure(df: DataFrame, text: Column) -> DataFrame:
    """Adds the counts that the thresholds refer to, under names that no column of ``df`` should have."""
    names = df.columns
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = df.withColumn("__q_text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumns({
        "__q_words": F.filter(F.split("__q_text", SPACE), lambda w: w != ""),
        "__q_lines": F.filter(F.split("__q_text", "\n"), lambda line: line.rlike(SOLID)),
        "__q_n_symbols": F.regexp_count("__q_text", F.lit(SYMBOL)).cast("long"),
    })
    for name, value in repeat_words("__q_words").items():
        df = df.withColumn(name, value)
    df = df.withColumn("__q_stop", F.filter("__q_words", lambda w: w.isin(stop)))
    df = df.withColumns({
        "__q_n_words": F.size("__q_words").cast("long"),
        "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "__q_n_stop_words": F.size("__q_stop").cast("long"),
        "__q_n_stop_kinds": F.size(F.array_distinct("__q_stop")).cast("long"),
        "__q_n_lines": F.size("__q_lines").cast("long"),
        "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
    })
    return df.select(*names, *(PREFIX + c for c in COUNTS))


def base_failed() -> Column:
    n = F.col("__q_n_words")
    return (n < 50) | (100 * F.col("__q_n_repeat_words") > 50 * n)


def verdict(thresholds: list[tuple] = THRESHOLDS) -> Column:
    """The table as one boolean expression; a ratio without a value (no words) fails."""
    def value(ratio: str) -> Column:
        count, _, of = ratio.partition(" / ")
        return F.try_divide(F.col(PREFIX + count), F.col(PREFIX + of)) if of else F.col(PREFIX + count)

    return reduce(lambda a, b: a & b, (F.coalesce(value(ratio).between(least, most), F.lit(False)) for _, ratio, least, most in thresholds))


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept; other columns of ``docs`` are left out."""
    out = measure(docs.select("doc_id", F.col(text_col).alias("__q_text")), F.col("__q_text"))
    return out.select("doc_id", *(F.col(PREFIX + c).alias(c) for c in COUNTS), settled(base_failed()).alias("base_failed"), settled(~base_failed() & verdict(thresholds)).alias("kept"))


def kept_rows(docs: DataFrame, text_col: str = "text", thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that the base rule and the table keep, with their columns, whatever their names but ``__q_...``."""
    kept = measure(docs, docs[text_col]).withColumn("__q_kept", settled(~base_failed() & verdict(thresholds)))
    return kept.where("__q_kept").select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same result in DuckDB's SQL, from the same table of thresholds."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    rules = " AND ".join(f"coalesce(({ratio}) BETWEEN {least} AND {most}, false)" for _, ratio, least, most in THRESHOLDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words, len(list_distinct(list_filter(ws, lambda x: x IN ({stop})))) AS n_stop_kinds
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules} AS kept
FROM m"""
