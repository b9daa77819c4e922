"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, written to the shared folder before the next one, so no component, however
large, meets in one task. Edges are pairs of ids (a, b); loops and repeats do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.common import Stages

#: Edges that a task contracts at once before the first step.
CHUNK = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by repeated minimum over edges and halving of paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each chunk by edges to the least node of their component within the chunk."""
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, root = _roots(table["a"].to_numpy(), table["b"].to_numpy())
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > CHUNK:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.selectExpr("a as node", "b as component").union(stars.selectExpr("b", "b").distinct())


def components(edges: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """(node, component) for each node of an edge; component is the least node that is reachable."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stages.write(edges, f"{name}-edges")
    few = edges.count() <= CHUNK
    e = stages.write((edges.coalesce(1) if few else edges).mapInArrow(_contract, "a long, b long"), f"{name}-0")  # a > b from here on
    if few:  # one chunk holds them all, and is contracted whole
        return _labels(e)
    k, was = 0, None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == was:
            return _labels(e)
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v as a", "m as b").distinct()
        e1 = stages.write(large, f"{name}-{k}l")
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low, "a").selectExpr("b as a", "m as b").union(low.selectExpr("a", "m")).where("a <> b").distinct()
        e2 = stages.write(small, f"{name}-{k + 1}")
        stages.drop(f"{name}-{k}")
        stages.drop(f"{name}-{k}l")
        e, was, k = e2, now, k + 1
