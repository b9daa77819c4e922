"""Differences of sources against every term of every pair."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from loomtrail.llm import divergence
from loomtrail.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, value string"


def by_definition(rows: list[tuple], least: int, k: int) -> set[tuple]:
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(of: Counter, kept: list[str] = kept) -> dict[str, int]:
            total = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own, whole = p(counts[lang, source]), p(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                q = p(counts[lang, other])
                pairs.append((other, sum((own[t] - q[t]) ** 2 // (own[t] + q[t]) for t in kept)))
        terms = [(t, (own[t] - whole[t]) ** 2 // (own[t] + whole[t])) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(ranked[:most])}
    return out


def corpus(n: int, words: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["Der", "der", "é", "ÉT", "été", "naïve", "日本", "x1y", "a_b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), "hot" if rng.random() < 0.35 else rng.choice([None, "a", "b", "ä", "z", "empty" if rng.random() < 0.2 else "c"])
        text = None if source == "empty" or rng.random() < 0.05 else " ".join(rng.choice(vocabulary[: 20 + (hash(source or "") % 5 + 1) * words // 5]) for _ in range(rng.randint(0, 60)))
        rows.append((i if rng.random() < 0.9 else None, text, lang, source, "v"))
    return rows + rows[:20] + [(1, None, "xx", "alone", "v"), (2, "rare words", "yy", "p", "v"), (3, "other ones", "yy", "q", "v"), (4, "same " * 3, "zz", "p", "v")] + [(9, "tie tie up", "tt", s, "v") for s in "ab" for _ in range(12)]


@pytest.mark.parametrize(("seed", "least", "k"), [(1, 10, 10), (2, 3, 2), (3, 1, 1)])
def test_by_definition(spark, seed, least, k):
    rows = corpus(300, 200, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {tuple(r) for r in divergence.source_divergence(df, least=least, k=k).collect()} == by_definition(rows, least, k)


def test_cuts(spark, monkeypatch):
    """Long texts in pieces, counts passed on early, and pairs in small slices give the same."""
    rows = corpus(120, 100, 4) + [(1, "ümlaut Abc " * 2000, "en", "hot", "v")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    text = ("aé" * 30 + " ").encode() * 9
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert sum(map(len, divergence._pieces(text))) == 9 and list(divergence._pieces(b"")) == []
    monkeypatch.undo()
    want = by_definition(rows, 10, 10)
    for name, value in (("PIECE", 50), ("HELD", 30), ("SLICE", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.source_divergence(df).collect()} == want
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_against_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = QUERIES["op12_source_divergence"](spark, data)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op12_source_divergence']})").fetchall()
    assert sorted(want) == sorted(map(tuple, df.collect())) and len(want) > 100
