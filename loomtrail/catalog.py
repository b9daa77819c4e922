"""The registry of queries and their SQL; each module of ``plans`` holds one family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtrail.plans import audit, bundled, cased, checked, choices, documents, failures, joins, logs, modular, mutated, prefix, records, rubric, ruled, runs, scores, sessions, statements, structure

_FAMILIES = (scores, logs, joins, runs, failures, choices, documents, ruled, rubric, prefix, audit, modular, structure, statements, sessions, records, checked, bundled, cased, mutated)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _FAMILIES for k, v in m.ORACLE.items()}
FLAGSHIP = "pass_at_k"
