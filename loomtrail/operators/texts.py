"""Text operators: leaks by shared n-grams, expectations in criteria, keyword coverage, mark-up, slugs, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words, joined by spaces."""
    last = F.size(words) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


#: N-grams of hidden texts that are broadcast at most, at about 30 bytes each; beyond that the join shuffles.
BROADCAST_GRAMS = 500_000


def _gram_hashes(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(n))))
    return F.when(last >= 1, F.array_distinct(hashes)).otherwise(F.array().cast("array<long>"))


def ngram_leaks(texts: DataFrame, ident: str, text: str, hidden: DataFrame, hidden_id: str, hidden_text: str, n: int = 5) -> DataFrame:
    """Pairs of a text and a hidden one that share n-grams, with their number: an equi-join on the n-gram's 64-bit hash.

    Texts are cut where they are read. If the hidden n-grams are few they are broadcast, so that no others are shuffled.
    """
    def grams(df: DataFrame, i: str, t: str) -> DataFrame:
        return df.select(i, tokens(F.col(t)).alias("_w")).select(i, F.explode(_gram_hashes(F.col("_w"), n)).alias("_g"))

    a, b = grams(texts, ident, text), grams(hidden, hidden_id, hidden_text)
    few = b.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return a.join(F.broadcast(b) if few else b, "_g").groupBy(ident, hidden_id).agg(F.count("*").alias("n_shared"))


def _labelled(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def expectations(df: DataFrame, ident: str, text: str) -> DataFrame:
    """E-mail addresses, ISO dates and amounts in a text: (id, kind, value), each once."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "date": r"\b\d{4}-\d{2}-\d{2}\b", "phone": r"\+\d[\d -]{7,}\d"}
    kinds = [F.transform(F.regexp_extract_all(text, F.lit(p), 0), _labelled(k)) for k, p in patterns.items()]
    return df.select(ident, F.explode(F.array_distinct(F.concat(*kinds))).alias("_e")).select(ident, "_e.kind", "_e.value")


def keyword_coverage(criteria: DataFrame, cid: str, ctext: str, least: int, stop: list[str], words: DataFrame, word: str) -> DataFrame:
    """Share of a criterion's keywords that occur in ``words`` (distinct), as such or without a final s."""
    key = F.filter(F.array_distinct(tokens(F.col(ctext))), lambda w: (F.length(w) >= least) & ~w.isin(stop))
    each = criteria.select(cid, F.explode(key).alias("_k"))
    hit = each.select(cid, "_k", F.explode(F.array_distinct(F.array("_k", F.regexp_replace("_k", "s$", "")))).alias(word)).join(words.select(word).distinct(), word, "left_semi").select(cid, "_k").distinct().withColumn("_hit", F.lit(1))
    return each.join(hit, [cid, "_k"], "left").groupBy(cid).agg(F.count("*").alias("n_keywords"), F.count("_hit").alias("n_found"))


def plain_of_markup(c: Column) -> Column:
    """Text without tags, scripts and five entities, white space collapsed."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "_"), r"([a-z0-9])([A-Z])", "$1_$2"))


def without_marked(c: Column, opening: str, closing: str) -> Column:
    """Text without the stretches between two marks."""
    return F.trim(F.regexp_replace(c, rf"(?s)\Q{opening}\E.*?\Q{closing}\E", ""))


def fenced_json(c: Column) -> Column:
    """The JSON object in a fenced block, else the text from the first brace to the last."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fence != "", fence).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def token_estimate(chars: Column, images: Column, per_image: int, most_images: int) -> Column:
    return F.ceil(chars / 4) + F.least(images, F.lit(most_images)) * per_image
