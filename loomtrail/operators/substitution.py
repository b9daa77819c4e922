"""Literal patterns in texts: first matches and replacements, with one automaton for all patterns.

The automaton (Aho and Corasick) is built once per Python worker from the pattern table and passes over each text once,
however many patterns there are. The patterns of one automaton hold ``MOST`` characters; a larger table is dealt into
several ones by hash, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton, which each worker holds (about 100 bytes for each).
MOST = 4_000_000
_WORKER: dict[int, ahocorasick.Automaton] = {}


def _automaton(patterns: list[tuple]) -> ahocorasick.Automaton:
    """One per worker and pattern list; a later list takes the place of an earlier one."""
    key = hash(tuple(patterns))
    if key not in _WORKER:
        _WORKER.clear()
        found = ahocorasick.Automaton()
        for pattern, *rest in patterns:
            found.add_word(pattern, (len(pattern), *rest))
        found.make_automaton()
        _WORKER[key] = found
    return _WORKER[key]


def _slices(patterns: DataFrame, pattern_col: str) -> list[DataFrame]:
    size = patterns.agg(F.coalesce(F.sum(F.length(pattern_col)), F.lit(0))).first()[0]
    n = -(-size // MOST) or 1
    return [patterns.where(F.pmod(F.xxhash64(pattern_col), F.lit(n)) == k) for k in range(n)]


def first_matches(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame, name_col: str, pattern_col: str, id_type: str = "long") -> DataFrame:
    """id, name, at (1 for the first character), pattern and n_matches: where a text first holds a pattern of each name.

    A name may have several patterns; of those that match at one place the longest is given, and all matches count, also
    overlapping ones. Null and empty texts and patterns match nothing; texts without a match give no row; ids must be unique if
    the patterns need several automata.
    """
    out = None
    named = patterns.where(F.length(pattern_col) > 0).select(F.col(name_col).cast("string").alias("name"), F.col(pattern_col).alias("pattern")).distinct()
    parts = _slices(named, "pattern")
    for part in parts:
        names: dict[str, list[str]] = {}
        for r in part.collect():  # MOST characters
            names.setdefault(r["pattern"], []).append(r["name"])
        words = sorted((p, p, *sorted(n)) for p, n in names.items())

        def each(batches: Iterator[pa.RecordBatch], words: list[tuple] = words) -> Iterator[pa.RecordBatch]:
            found = _automaton(words) if words else None
            for b in batches:
                rows = []
                for ident, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                    text = text.as_py()
                    if not text or found is None:
                        continue
                    best: dict[str, tuple[int, int, str]] = {}
                    count: dict[str, int] = {}
                    for end, (size, pattern, *of) in found.iter(text):
                        for name in of:
                            count[name] = count.get(name, 0) + 1
                            best[name] = min(best.get(name, (len(text) + 1, 0, "")), (end - size + 2, -size, pattern))
                    rows += [(ident, name, at, pattern, count[name]) for name, (at, _, pattern) in best.items()]
                if rows:
                    ids, names, at, pattern, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names), pa.array(at, pa.int64()), pa.array(pattern), pa.array(n, pa.int64())], names=["id", "name", "at", "pattern", "n_matches"])

        got = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, f"id {id_type}, name string, at long, pattern string, n_matches long")
        out = got if out is None else out.union(got)
    if len(parts) == 1:
        return out
    best = F.min(F.struct("at", (-F.length("pattern")).alias("size"), "pattern"))
    return out.groupBy("id", "name").agg(best.alias("b"), F.sum("n_matches").alias("n_matches")).select("id", "name", "b.at", "b.pattern", "n_matches")


def substituted(texts: DataFrame, text_col: str, values: DataFrame, old_col: str, new_col: str, least: int = 1) -> DataFrame:
    """All columns of ``texts`` with the old values in a text replaced by the new ones, and n_replaced.

    Matches do not overlap: the leftmost goes first, the longest of those that begin there, and what was put in is not
    looked at again. Old values of fewer than ``least`` characters are left alone, those that stay the same are not counted; of several
    new values for one old value the least is taken. Null texts stay null. All values must fit one automaton (``MOST`` characters), else this raises.
    """
    pairs = values.where((F.length(old_col) >= max(least, 1)) & F.col(new_col).isNotNull()).groupBy(F.col(old_col).alias("old")).agg(F.min(new_col).alias("new"))
    if (size := pairs.agg(F.coalesce(F.sum(F.length("old")), F.lit(0))).first()[0]) > MOST:
        raise ValueError(f"{size} characters of old values; one pass takes {MOST}")
    words = sorted((r["old"], r["new"]) for r in pairs.collect())
    at = texts.columns.index(text_col)
    names = [*texts.columns, "n_replaced"]

    def replaced(text: str | None) -> tuple[str | None, int]:
        if not text or not words:
            return text, 0
        longest: dict[int, tuple[int, str]] = {}  # by where a match begins; ends come in order, so the last one is the longest
        for end, (size, new) in _automaton(words).iter(text):
            longest[end - size + 1] = (end + 1, new)
        out, last, free, n = [], 0, 0, 0
        for start in sorted(longest):
            end, new = longest[start]
            if start < free:
                continue
            free = end
            if new != text[start:end]:
                out += [text[last:start], new]
                last, n = end, n + 1
        return ("".join([*out, text[last:]]), n) if n else (text, 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [replaced(x.as_py()) for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in got], pa.int32())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", n_replaced int"
    return texts.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(each, schema)
