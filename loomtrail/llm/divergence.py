"""Audit of sources: which sources of a language differ, and in which terms.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that
occur in at least ``least`` of its documents. A group is a language and one of its sources; its probability of a kept
term with ``count`` occurrences is p = 1 + floor(SCALE * (count + 2) / (N + 2V)), with N the occurrences of all kept
terms in the group and V their number; the same holds for the whole language. Two probabilities differ by
f = floor((p - q)^2 / (p + q)). All numbers are integers.

Terms are counted within each task before anything is shuffled, so one source with a third of all rows is no hot key.

Leading terms come from an upper-bound search. The terms of a group form buckets by their count (a power of two each);
the largest count and the least probability in the language that occur in a bucket bound f for its terms. Buckets are
taken best bound first, a doubling number of them per round and all groups at once, until the bounds of all unseen
buckets are strictly below the group's k-th best value; ties at that value are therefore all seen.

Pairs of sources come from the posting lists of terms. Of two sources, terms that neither holds add the same value
each, terms that one holds add a value that follows from its count alone, and only terms that both hold are looked at
one by one: a posting list adds to each pair in it what differs from that. A posting list has an entry per source at
most, and the table of pairs that is asked for grows with the square of that; lists are worked through in slices.

Null texts, languages and sources are empty. Repeated rows count again, ids do not matter, other columns are ignored,
long texts are cut between terms and counted piece by piece, and an empty table gives no rows. A group without kept
terms has pairs and no terms; equal values are ranked by the UTF-8 bytes of the item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages, ragged

SCALE = 1_000_000_000
#: Bytes of a text that are handled at once, entries of a task's counts before they are passed on, and pairs of a slice.
PIECE, HELD, SLICE = 4 << 20, 400_000, 1 << 19
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: The reach of a bucket: counts between neighbouring powers of two.
BUCKET = "cast(floor(log2(n)) as int)"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            inner = TERM.match(text, end)
            end = inner.end() if inner and TERM.match(text, end - 1) else end
        yield TERM.findall(text[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences, documents: sums of the task so far, whenever there are many."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for lo in range(0, len(terms), 50_000):
                part = terms[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for b in batches:
        text = b.column("text").cast(pa.large_string()).cast(pa.large_binary())
        for lang, source, raw in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), text, strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in _pieces(raw.as_py()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held > HELD:
                yield from out()
                counts, held = {}, 0
    yield from out()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source), and the occurrences n and documents of each term of a group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.select("lang", "source").distinct(), counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """p of a term; decimals, as the products outgrow 64 bits on a large corpus."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n.cast(wide) + 2), total.cast(wide) + kept.cast(wide) + kept.cast(wide)) + 1


def difference(p: Column, q: Column) -> Column:
    """f of two probabilities; the square is below 2^60."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def leading_terms(terms: DataFrame, stages: Stages, k: int = 10) -> DataFrame:
    """lang, source, item, value of every term that can be among a group's first k. Takes lang, source, term, n, p, q."""
    terms = stages.write(terms.where("p > q").withColumn("bucket", F.expr(BUCKET)), "candidates")
    # f grows with p and, below p, falls with q; a bucket's best pair bounds all of its terms
    buckets = terms.groupBy("lang", "source", "bucket").agg(difference(F.max("p"), F.min("q")).alias("bound"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    buckets = stages.write(buckets.withColumn("place", F.row_number().over(order)), "buckets")  # a group has 63 buckets at most
    seen, open_, lo, width = None, buckets, 0, 4
    while not open_.isEmpty():
        now = open_.where((F.col("place") > lo) & (F.col("place") <= lo + width)).select("lang", "source", "bucket")
        found = terms.join(now, ["lang", "source", "bucket"]).select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
        found = found if seen is None else seen.union(found)
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        seen = stages.write(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), f"seen-{lo}")
        kth = seen.groupBy("lang", "source").agg(F.when(F.count("*") == k, F.min("value")).alias("kth"))
        rest = buckets.where(F.col("place") > lo + width).join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
        open_ = stages.write(rest, f"open-{lo}")
        lo, width = lo + width, 2 * width
    return seen if seen is not None else terms.selectExpr("lang", "source", "term as item", "n as value").limit(0)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each posting list adds to each pair of its sources, summed over a slice of pairs at a time."""
    for b in batches:
        lists = b.column("posting")
        flat = lists.flatten()
        at, p, zero = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("id", "p", "zero"))
        ids, code = np.unique(at, return_inverse=True)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(at)) - 1  # entries behind each one in its list
        ends = np.cumsum(left)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            n = left[lo:hi]
            a, c = np.repeat(np.arange(lo, hi), n), ragged(np.arange(lo, hi) + 1, n)
            pa_, pc, za, zc = p[a], p[c], zero[a], zero[c]
            add = _f(pa_, pc) - _f(pa_, zc) - _f(za, pc) + _f(za, zc)
            pairs, back = np.unique(code[a] * len(ids) + code[c], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, back, add)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(ids)]), pa.array(ids[pairs % len(ids)]), pa.array(total)], names=["a", "b", "add"])
            lo = hi


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_values(groups: DataFrame, terms: DataFrame, stages: Stages) -> DataFrame:
    """lang, source, item, value of every two sources of a language. Takes groups (id, lang, source, kept, zero) and terms (id, lang, term, n, p)."""
    other = groups.select("lang", F.col("id").alias("b"), F.col("source").alias("item"), F.col("zero").alias("q"))
    own = groups.select("lang", F.col("id").alias("a"), "source", "kept", F.col("zero").alias("z"))
    none = own.join(other, "lang").where("a <> b").select("lang", "source", "item", "a", "b", (F.col("kept") * difference(F.col("z"), F.col("q"))).alias("add"))
    # a group's terms with one count count together
    counts = terms.groupBy("id", "lang", "p").agg(F.count("*").alias("same")).withColumnRenamed("id", "a")
    one = counts.join(own.select("a", "z"), "a").join(other.select("lang", "b", "q"), "lang").where("a <> b")
    one = one.select("a", "b", (F.col("same") * (difference(F.col("p"), F.col("q")) - difference(F.col("z"), F.col("q")))).alias("add")).groupBy("a", "b").agg(F.sum("add").alias("add"))
    lists = terms.join(groups.select("id", "zero"), "id").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("id", "p", "zero"))).alias("posting"))
    both = lists.where(F.size("posting") > 1).select("posting").mapInArrow(_shared, "a long, b long, add long").groupBy("a", "b").agg(F.sum("add").alias("add"))
    parts = one.unionByName(one.selectExpr("b as a", "a as b", "add")).unionByName(both).unionByName(both.selectExpr("b as a", "a as b", "add"))
    parts = stages.write(parts.groupBy("a", "b").agg(F.sum("add").alias("more")), "parts")
    return none.join(parts, ["a", "b"], "left").select("lang", "source", "item", (F.col("add") + F.coalesce("more", F.lit(0))).alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    stages = Stages(docs.sparkSession, "divergence")
    groups, counted = term_counts(docs, lang_col, source_col, text_col)
    counted = stages.write(counted, "counted")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("d")).where(F.col("d") >= least).drop("d")
    kept = stages.write(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("m").alias("all"))
    terms = stages.write(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "all"])
    groups = groups.withColumn("zero", F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1))
    groups = stages.write(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    of_group = groups.select("lang", "source", "id", "total", "kept", "all")
    terms = terms.join(of_group, ["lang", "source"]).select("id", "lang", "source", "term", "n", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), probability(F.col("m"), F.col("all"), F.col("kept")).alias("q"))
    terms = stages.write(terms, "probabilities")
    pair = pair_values(groups, terms.drop("source", "q"), stages).withColumn("part", F.lit("pair"))
    term = leading_terms(terms.drop("id"), stages, k).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", rank.alias("rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """Every kept term of every group and pair, without bounds."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{80}}-\x{{10FFFF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS m FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(m)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, k.m, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + ({SCALE}::HUGEINT * (x.n + 2)) // (s.total + 2 * l.v) AS p, 1 + ({SCALE}::HUGEINT * (x.m + 2)) // (l.total + 2 * l.v) AS q
  FROM cells x JOIN sums s USING (lang, source) JOIN langs l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
one AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM one) WHERE part = 'pair' OR rank <= 10
"""
