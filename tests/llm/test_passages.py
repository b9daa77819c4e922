"""Passages against every pair of runs of words, and the filter of ids."""

from __future__ import annotations

import random

from loomtrail.llm import chain_dedup, common
from loomtrail.llm.common import Stages


def repeats(words: dict[int, list[str]], least: int) -> dict[int, set[int]]:
    """The words of each document that lie in a run of ``least`` that begins earlier too."""
    first: dict[tuple, tuple] = {}
    for k in sorted(words):
        for i in range(len(words[k]) - least + 1):
            first.setdefault(tuple(words[k][i : i + least]), (k, i))
    out: dict[int, set[int]] = {k: set() for k in words}
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] != (k, i):
                out[k] |= set(range(i, i + least))
    return out


def test_every_exact_repeat_is_found(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    pool = [fresh(rng.randint(50, 120)) for _ in range(6)]
    words: dict[int, list[str]] = {}
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            whole = rng.choice(pool)
            lo = rng.randint(0, max(0, len(whole) - 50))
            parts += fresh(rng.randint(0, 80)) + rng.choice([[], whole, whole[lo:], whole[: lo + 50]])
        words[k] = parts
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "doc_id long, text string").repartition(4)
    covered: dict[int, set[int]] = {k: set() for k in words}
    for r in chain_dedup.passages(df).collect():
        text, source = " ".join(words[r.doc_id]), " ".join(words[r.source_id])
        own, other = text[r.start : r.end].split(" "), source[r.source_start : r.source_end].split(" ")
        before = len(text[: r.start].split(" ")) - 1 if r.start else 0
        assert own == words[r.doc_id][before : before + len(own)] and len(own) == r.n_words >= 50
        assert (r.source_id, r.source_start) < (r.doc_id, r.start) and 100 * r.n_same >= 75 * max(len(own), len(other))
        covered[r.doc_id] |= set(range(before, before + len(own)))
    want = repeats(words, 50)
    assert sum(map(len, want.values())) > 1000
    assert all(want[k] <= covered[k] for k in words)
    clean = {k: len(covered[k] - want[k]) for k in words}
    assert sum(clean.values()) < 0.1 * sum(map(len, want.values()))  # fuzzy ends beyond the exact runs


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3).toDF("k")
    rows = spark.range(-10, 3000).toDF("doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    for bits, chunk in ((1 << 27, 1 << 15), (1 << 12, 1 << 6)):
        table = common.id_filter(ids, Stages(spark, "test"), "ids", bits, chunk)
        got = common.with_marks(rows, rows["doc_id"], table, bits, chunk)
        assert got.count() == rows.count() and got.where("doc_id is null and __q_in").isEmpty()
        assert got.where("doc_id >= 0 and doc_id % 3 = 0 and not __q_in").isEmpty()
        false = got.where("__q_in and (doc_id < 0 or doc_id % 3 <> 0)").count()
        assert false < (20 if bits == 1 << 27 else 900)
    assert common.with_marks(rows, rows["doc_id"], common.id_filter(ids.limit(0), Stages(spark, "test"), "none")).where("__q_in").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
