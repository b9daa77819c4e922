"""Graphs of work steps: closure, depths, components, cycles, sinks, and keys between tables.

Rounds end when nothing is new, however deep or wide the graph; where a cycle has no result, more rounds than the graph
has nodes raise. Each round's rows are written once, to the checkpoint folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Edges that one task takes at most.
CHUNK = 1 << 18


def prepare_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from the session; a temporary one only in local mode, as in tests."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomtrail-"))


def _rounds(first: DataFrame, edges: DataFrame, step, by: list[str] | None = None, acyclic: bool = False, most: int | None = None) -> DataFrame:
    """All rows reached from ``first``, round by round, until none is new in the columns ``by`` (all columns if not given).

    Where a cycle would go on for ever, more than ``most`` rounds raise: if not given, the number of nodes with an edge out.
    """
    prepare_checkpoints(first.sparkSession)
    by = by or first.columns
    pieces = [first.dropDuplicates(by).checkpoint()]
    if acyclic and most is None:
        most = edges.select(edges.columns[0]).distinct().count()
    while True:
        known = reduce(DataFrame.union, pieces)
        new = step(pieces[-1], edges).dropDuplicates(by).join(known.select(*by), by, "left_anti").checkpoint()
        if new.isEmpty():
            return known
        pieces.append(new)
        if most is not None and len(pieces) > most + 1:
            raise ValueError(f"the graph is deeper than {most} or has a cycle")


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(ancestor, node) for every pair of nodes that a path joins, in any graph."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    return _rounds(e, e, lambda new, e: new.join(e.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))).toDF("ancestor", "node")


def depths(nodes: DataFrame, node: str, edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """Longest and shortest distance of each node from the nodes without predecessors."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    roots = nodes.select(F.col(node).alias("node")).join(e.select(F.col("t").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(0))
    walked = _rounds(roots, e, lambda new, e: new.join(e, F.col("node") == F.col("s")).select(F.col("t").alias("node"), (F.col("depth") + 1).alias("depth")), acyclic=True, most=most)
    return walked.groupBy("node").agg(F.max("depth").alias("longest"), F.min("depth").alias("shortest"))


def sinks(nodes: DataFrame, node: str, edges: DataFrame, source: str) -> DataFrame:
    return nodes.join(edges.select(F.col(source).alias(node)).distinct(), node, "left_anti")


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Fan-in and fan-out of each node."""
    both = edges.select(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select(source, F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def infer_keys(columns: DataFrame, suffix: str) -> DataFrame:
    """Relations between tables by column names: a column <prefix>_<name><suffix> refers to the table whose first column has that name and suffix.

    ``columns`` has table, column and position.
    """
    stem = F.regexp_extract("column", rf"^[a-z]+_([a-z]+{suffix})$", 1)
    named = columns.withColumn("stem", stem).where("stem <> ''")
    target = named.where("position = 0").select(F.col("table").alias("to_table"), F.col("column").alias("to_column"), "stem")
    out = named.join(target, "stem").where(F.col("table") != F.col("to_table"))
    return out.select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table", "to_column")


def key_paths(relations: DataFrame, most: int) -> DataFrame:
    """Fewest hops between any two tables, in either direction of a relation, up to ``most``."""
    e = relations.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    e = e.union(e.select("b", "a")).distinct()
    reach = hop = e.withColumn("hops", F.lit(1))
    for k in range(2, most + 1):
        hop = hop.select("a", F.col("b").alias("m")).distinct().join(e.toDF("m", "b"), "m").where("a <> b").select("a", "b").distinct().withColumn("hops", F.lit(k))
        reach = reach.union(hop)
    return reach.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def _longer(new: DataFrame, e: DataFrame) -> DataFrame:
    return new.join(e.toDF("target", "_t"), "target").select("source", F.col("_t").alias("target"), (F.col("length") + 1).alias("length"))


def path_lengths(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The fewest edges from each node to each one that it reaches; a pair is extended in the round only that finds it."""
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    return _rounds(e.withColumn("length", F.lit(1).cast("long")), e, _longer, ["source", "target"])


def carry_distances(edges: DataFrame, source: str, target: str, threshold: int) -> DataFrame:
    """For each edge how long the longest way between its ends is, and whether a value is carried that far; a cycle raises."""
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    walks = _rounds(e.withColumn("length", F.lit(1).cast("long")), e, _longer, acyclic=True)
    longest = walks.groupBy("source", "target").agg(F.max("length").alias("distance"))
    return e.join(longest, ["source", "target"]).withColumn("far", F.col("distance") >= threshold)


def least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches each node (itself included) over edges (a, b).

    A label's own label reaches the node too, so labels also jump, which shortens long paths.
    """
    prepare_checkpoints(nodes.sparkSession)
    label = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        over = edges.join(label.toDF("a", "label"), "a").select(F.col("b").alias("node"), "label")
        jump = label.where("label < node").join(label.toDF("label", "_l"), "label").where("_l < label").select("node", F.col("_l").alias("label"))
        found = over.union(jump).groupBy("node").agg(F.min("label").alias("low"))
        new = label.join(found, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), F.coalesce(F.col("low") < F.col("label"), F.lit(False)).alias("moved")).checkpoint()
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label


def _strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, root) of the components of two nodes and more of edges (x, y): depth-first search with a stack of its own."""
    after: dict[str, list[str]] = {}
    for pdf in batches:
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            after.setdefault(x, []).append(y)
    place: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    at: dict[str, int] = {}  # where a held node stands in ``held``
    out = []

    def enter(node: str) -> None:
        place[node] = low[node] = len(place)
        at[node] = len(held)
        held.append(node)

    for start in after:
        if start in place:
            continue
        enter(start)
        todo = [(start, iter(after[start]))]
        while todo:
            node, rest = todo[-1]
            for y in rest:
                if y not in place:
                    enter(y)
                    todo.append((y, iter(after.get(y, ()))))
                    break
                if y in at:
                    low[node] = min(low[node], place[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == place[node]:
                    own = held[at[node] :]
                    del held[at[node] :]
                    for k in own:
                        del at[k]
                    if len(own) > 1:
                        out += [(k, node) for k in own]
    yield pd.DataFrame(out, columns=["x", "root"])


def _name(node: str) -> Column:
    return F.to_json(F.struct(F.col(node).alias("v")))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, root): nodes of edges (x, y) that a task meets, with one node for each connected part of ``CHUNK`` edges or a batch more."""
    up: dict[str, str] = {}
    n = 0

    def top(x: str) -> str:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    def out() -> pd.DataFrame:
        return pd.DataFrame({"x": list(up), "root": [top(x) for x in list(up)]}, dtype=str)

    for pdf in batches:
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            a, b = top(x), top(y)
            if a != b:
                up[max(a, b)] = min(a, b)
        n += len(pdf)
        if n >= CHUNK:
            yield out()
            up.clear()
            n = 0
    yield out()


def _connected(e: DataFrame) -> DataFrame:
    """(x, part): the connected part of each node of edges (x, y), both texts.

    Each task joins what is connected within its own rows; a node that several of them meet links their roots, and only roots take rounds.
    """
    stars = e.mapInPandas(_stars, "x string, root string").checkpoint()
    met = stars.groupBy("x").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")).checkpoint()
    links = met.where(F.size("roots") > 1).select("low", F.explode("roots").alias("root")).where("low <> root")
    both = links.select(F.col("low").alias("a"), F.col("root").alias("b")).union(links.select("root", "low")).distinct().checkpoint()
    if both.isEmpty():
        return met.select("x", F.col("low").alias("part"))
    label = least_reaching(both.select(F.col("a").alias("node")).distinct(), both).toDF("low", "part")
    return met.join(label, "low", "left").select("x", F.coalesce("part", "low").alias("part"))


def _settled(e: DataFrame) -> DataFrame:
    """(node, component) of the components of edges (a, b, part), of which every part fits a task."""
    keyed = e.select(_name("a").alias("x"), _name("b").alias("y"), "a", "b", "part")
    roots = keyed.select("x", "y", "part").repartition(1 + 4 * e.count() // max(CHUNK, 1), "part").select("x", "y").mapInPandas(_strong, "x string, root string")
    nodes = keyed.select("x", F.col("a").alias("node")).union(keyed.select("y", "b")).distinct()
    both = nodes.join(roots, "x").select("node", "root")
    return both.join(both.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def _rooted(edges: pa.Table) -> pa.Table:
    """(a, b, root) with each node of a cycle once as ``a``, and b null; edges are (a, b, x, y)."""
    x, y = (edges[c].to_pylist() for c in ("x", "y"))
    strong = next(_strong(iter([pd.DataFrame({"x": x, "y": y})])))
    roots = dict(zip(strong["x"], strong["root"], strict=True))
    for name, other in zip(x, y, strict=True):
        if name == other:
            roots.setdefault(name, name)
    at = {name: k for k, name in enumerate(x) if name in roots}
    a = edges["a"].take(pa.array(list(at.values()), pa.int64()))
    return pa.table([a, pa.nulls(len(at), a.type), pa.array([roots[name] for name in at], pa.string())], names=["a", "b", "root"])


def _within(chunk: int):
    """(a, b, root) of edges (a, b, x, y, n) whose parts come whole behind each other, n edges each: nodes of cycles of parts of ``chunk`` edges at most, and the edges of larger ones, without a root."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rest = 0  # rows held, and those that the last part still lacks
        for batch in batches:
            n = batch.column("n").to_numpy()
            if (n > chunk).any():
                large = batch.filter(pa.array(n > chunk))
                yield pa.RecordBatch.from_arrays([large.column("a"), large.column("b"), pa.nulls(len(large), pa.string())], names=["a", "b", "root"])
                batch, n = batch.filter(pa.array(n <= chunk)), n[n <= chunk]
            at = whole = rest  # a part begins at ``whole``, the last one of the batch in the end
            while at < len(n):
                whole, at = at, at + int(n[at])
            whole, rest = at if at == len(n) else whole, at - len(n)
            if whole <= len(n) and size + whole >= chunk:
                yield from _rooted(pa.Table.from_batches([*held, batch.slice(0, whole)])).to_batches()
                held, size, batch = [], 0, batch.slice(whole)
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield from _rooted(pa.Table.from_batches(held)).to_batches()

    return each


def _parted(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component, members) of the cycles of edges (a, b, part) whose part has ``CHUNK`` edges at most, and the edges (a, b) of larger parts.

    Edges meet by part once. A part whose edges all lead to greater nodes, or all to lesser ones, has no cycle.
    """
    w = Window.partitionBy("part")
    seen = ends.select("*", F.count("*").over(w).alias("n"), F.max(F.col("a") < F.col("b")).over(w).alias("up"), F.max(F.col("a") > F.col("b")).over(w).alias("down"), F.max(F.col("a") == F.col("b")).over(w).alias("loop"))
    some = seen.where("(up and down) or loop").sortWithinPartitions("part").select("a", "b", _name("a").alias("x"), _name("b").alias("y"), "n")
    kind = StructType([StructField("a", ends.schema["a"].dataType), StructField("b", ends.schema["b"].dataType), StructField("root", StringType())])
    out = some.mapInArrow(_within(CHUNK), kind).checkpoint()
    own = Window.partitionBy("root")
    on = out.where("root is not null").select(F.col("a").alias("node"), F.min("a").over(own).alias("component"), F.count("*").over(own).alias("members"))
    return on, out.where("root is null").select("a", "b")


def cycle_members(edges: DataFrame, source: str, target: str, part: str | None = None) -> DataFrame:
    """(node, component, members) of every node on a cycle: components in which every node reaches every other.

    Nodes without an edge in or without one out are trimmed first. Then the least node that reaches each node and the
    least one that it reaches are found: where both are the same, they name the node's component. Edges between nodes
    that differ in either lie in no component and go, as do the components found; each round settles one at least in
    every connected part of what is left. First, and again whenever half of the edges have gone, the connected parts of ``CHUNK`` edges at most are settled, many
    of them in a task, so that only larger ones take rounds. A node that has only an edge to itself is a component of its own; edges with
    a null end are left out. Once ``CHUNK`` edges are left at most, one task settles them. ``part`` is a column that no two connected edges
    differ in, if there is one: its parts of ``CHUNK`` edges at most, repeated ones included, are settled where they meet, without a search for what is connected.
    """
    prepare_checkpoints(edges.sparkSession)
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), *([F.col(part).alias("part")] if part else [])).where("a is not null and b is not null")
    if part:
        settled, ends = _parted(ends)
        if ends.isEmpty():
            return settled
    raw = ends.checkpoint()
    e = raw.distinct().checkpoint()
    loops = e.where("a = b").select(F.col("a").alias("node"))
    found = e.where("false").selectExpr("a as node", "a as component")
    e = e.where("a <> b")
    tried = None
    while True:
        n = e.count()
        if n > CHUNK and (tried is None or 2 * n <= tried):
            tried = n
            parts = e.withColumn("x", _name("a")).join(_connected(raw.select(_name("a").alias("x"), _name("b").alias("y"))), "x").select("a", "b", "part").checkpoint()
            large = parts.groupBy("part").count().where(F.col("count") > CHUNK).select("part")
            found = found.union(_settled(parts.join(large, "part", "left_anti")))
            e = raw = parts.join(large, "part", "left_semi").select("a", "b").checkpoint()
        was, n = None, e.count()
        while n > CHUNK and n != was:
            was = n
            e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b").checkpoint()
            n = e.count()
        if n <= CHUNK:  # what is left fits a task, which settles it
            found = found.union(_settled(e.withColumn("part", F.lit(0)))) if n else found
            break
        nodes = e.selectExpr("a as node").union(e.selectExpr("b")).distinct()
        label = least_reaching(nodes, e).join(least_reaching(nodes, e.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("label", "back"), "node").checkpoint()
        found = found.union(label.where("label = back").select("node", "label"))
        left = label.where("label <> back")
        ends = left.toDF("a", "la", "ba"), left.toDF("b", "lb", "bb")
        e = e.join(ends[0], "a").join(ends[1], "b").where("la = lb and ba = bb").select("a", "b").checkpoint()
        raw = e
    size = found.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")  # a pivot may turn out to be alone
    on = found.join(size, "component").select("node", "component", "members")
    alone = loops.join(on, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("members"))
    return reduce(DataFrame.union, [on, alone, *([settled] if part else [])])


def component_ratio(nodes: DataFrame, node: str, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes, components, the largest one and the share of nodes outside it, by least labels over edges in both directions."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    prepare_checkpoints(nodes.sparkSession)
    both = e.union(e.select("b", "a")).distinct().checkpoint()
    label = least_reaching(nodes.select(F.col(node).alias("node")).distinct(), both)
    n = label.groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").cast("long").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("largest")).withColumn("ratio", F.bround(1 - F.col("largest") / F.col("n_nodes"), 4))


def complexity(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Measures of one graph of nodes (node, app, irreversible): depth, edges between applications, fan-in, branches, and where the first irreversible node is."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    d = depths(nodes, "node", edges, source, target).join(nodes, "node")
    deep = d.agg((F.max("longest") + 1).cast("long").alias("dependency_depth"), F.min(F.when(F.col("irreversible"), F.col("shortest") + 1)).cast("long").alias("irreversible_depth"))
    app = nodes.select("node", "app")
    cross = e.join(app.toDF("a", "x"), "a").join(app.toDF("b", "y"), "b").agg(F.count_if(F.col("x") != F.col("y")).alias("cross_app_edges"))
    fan = degrees(edges, source, target).agg(F.max("fan_in").alias("largest_fan_in"), F.count_if(F.col("fan_out") >= 2).alias("branches"))
    return deep.crossJoin(cross).crossJoin(fan)  # one row each


def semantic_horizon(pairs: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """For pairs (root, shown) the fewest edges between them, in whichever direction is shorter; 0 for the same node, null without a way."""
    p = path_lengths(edges, source, target)
    out = pairs.join(p.toDF("root", "shown", "_f"), ["root", "shown"], "left").join(p.toDF("shown", "root", "_b"), ["root", "shown"], "left")
    return out.select("root", "shown", F.when(F.col("root") == F.col("shown"), F.lit(0).cast("long")).otherwise(F.least("_f", "_b")).alias("horizon"))
