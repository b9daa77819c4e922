"""Search for compositions of modules, round by round.

A composition is a labelled graph: modules, and edges that feed an input port of one from an output port of another. A
round joins every composition of the beam with all modules that fit one of its ports, in either direction. Equal
compositions are found by a hash that does not depend on the order in which they were built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrail.operators.graphs import prepare_checkpoints

EDGE = "struct<s:int,o:string,t:int,i:string>"


def best_fits(fits: DataFrame, most: int) -> DataFrame:
    """The ``most`` best inputs for each output port and the best outputs for each input port, by score, then by name.

    Takes (a, out, b, into, score): output port ``out`` of module ``a`` fits input ``into`` of module ``b``.
    """
    forward = Window.partitionBy("a", "out").orderBy(F.desc("score"), "b", "into")
    back = Window.partitionBy("b", "into").orderBy(F.desc("score"), "a", "out")
    cut = [fits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r") for w in (forward, back)]
    return cut[0].union(cut[1]).distinct()


def _refined(members: Column, edges: Column, hashes: Column) -> Column:
    """Each member's hash from its module and, per edge, the ports and the hash at the other end, sorted."""
    def side(at: Column, own: str, other: str, sign: str) -> Column:
        texts = F.transform(F.filter(edges, lambda e: e[own] == at), lambda e: F.concat(F.lit(sign), e["o"], F.lit(">"), e["i"], F.lit(":"), F.get(hashes, e[other])))
        return F.array_join(F.array_sort(texts), ",")

    return F.transform(members, lambda m, p: F.md5(F.concat_ws("|", m.cast("string"), side(p, "s", "t", "+"), side(p, "t", "s", "-")).cast("binary")))


def with_form(states: DataFrame, size: int) -> DataFrame:
    """Adds ``form``: equal for two compositions of up to ``size`` modules if and only if they are the same labelled tree.

    Hashes are refined ``size`` - 1 times, so a member's hash tells the whole tree as seen from it.
    """
    out = states.withColumn("_h", F.transform("members", lambda m: F.md5(m.cast("string").cast("binary"))))
    for _ in range(size - 1):
        out = out.withColumn("_h", _refined(F.col("members"), F.col("edges"), F.col("_h")))
    return out.withColumn("form", F.md5(F.array_join(F.array_sort("_h"), ",").cast("binary"))).drop("_h")


def _expanded(states: DataFrame, fits: DataFrame) -> DataFrame:
    """Every way to add a module to a composition by one edge; an input is fed once, and a seed alone does not take itself."""
    each = states.select("*", F.posexplode("members").alias("_p", "_m"))
    new = F.size("members").cast("int")
    alone = F.size("members") == 1
    ahead = each.join(fits.withColumnRenamed("a", "_m"), "_m").where(~(alone & (F.col("b") == F.col("_m")))).select("seed", "members", "edges", F.col("score") + F.col("fit"), F.col("n_nodes") + F.col("size_b"), F.col("b").alias("added"), F.struct(F.col("_p").alias("s"), F.col("out").alias("o"), new.alias("t"), F.col("into").alias("i")).alias("edge"))
    fed = F.exists("edges", lambda e: (e["t"] == F.col("_p")) & (e["i"] == F.col("into")))
    back = each.join(fits.withColumnRenamed("b", "_m"), "_m").where(~fed & ~(alone & (F.col("a") == F.col("_m")))).select("seed", "members", "edges", F.col("score") + F.col("fit"), F.col("n_nodes") + F.col("size_a"), F.col("a").alias("added"), F.struct(new.alias("s"), F.col("out").alias("o"), F.col("_p").alias("t"), F.col("into").alias("i")).alias("edge"))
    both = ahead.union(back).toDF("seed", "members", "edges", "score", "n_nodes", "added", "edge")
    return both.select("seed", F.concat("members", F.array("added")).alias("members"), F.concat("edges", F.array(F.col("edge").cast(EDGE))).alias("edges"), "score", "n_nodes")


def beam_rounds(modules: DataFrame, fits: DataFrame, rounds: int, width: int, budget: int, gate: Column, min_nodes: int, max_nodes: int) -> DataFrame:
    """seed, round, form, members, edges, score and n_nodes of the compositions accepted in each round.

    ``modules`` has (module, n_nodes), each one a seed of its own; ``fits`` has (a, out, b, into, score) with whole
    numbers. A composition scores the sum of its edges' scores. Those with fewer than ``min_nodes`` or more than
    ``max_nodes`` nodes are rejected. Of the others the best ``budget`` of each seed are checked by ``gate`` (a condition
    on form, members, edges, score and n_nodes), and the best ``width`` that pass are accepted and go on; equal scores are ordered by form.
    """
    prepare_checkpoints(modules.sparkSession)
    sizes = modules.select("module", F.col("n_nodes").cast("long").alias("size"))
    # both sides of every round: worked out once, with the sizes of the modules that they add; fits of unknown modules go
    fits = fits.withColumnRenamed("score", "fit").join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b").checkpoint()
    beam = modules.select(F.col("module").alias("seed"), F.array("module").alias("members"), F.array().cast(f"array<{EDGE}>").alias("edges"), F.lit(0).cast("long").alias("score"), F.col("n_nodes").cast("long").alias("n_nodes"))
    accepted = []
    for k in range(1, rounds + 1):
        # nodes are counted as modules are added, so that what is rejected is never hashed
        found = with_form(_expanded(beam, fits).where(F.col("n_nodes").between(min_nodes, max_nodes)), k + 1)
        # the same tree may come with its members in another order; its score is the same
        found = found.groupBy("seed", "form", "score", "n_nodes").agg(F.min(F.struct("members", "edges")).alias("g")).select("seed", "form", "score", "n_nodes", "g.members", "g.edges")
        order = Window.partitionBy("seed").orderBy(F.desc("score"), "form")
        checked = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget).where(gate)
        beam = checked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r").withColumn("round", F.lit(k)).checkpoint()
        accepted.append(beam)
        if beam.isEmpty():
            break
    return reduce(DataFrame.union, accepted).select("seed", "round", "form", "members", "edges", "score", "n_nodes")


#: In front of the steps of the first and of the second parent, and the port of a condition (fixed values).
FIRST, SECOND, GATE = "a_", "b_", "gate"


def composed_id(kind: str | None, *parts: Column) -> Column:
    """The name of a composition: gen- and ten digits of the sha256 of what it is made of."""
    return F.concat(F.lit("gen-"), F.left(F.sha2(F.concat(*([F.lit(f"{kind}|")] if kind else []), *parts), 256), F.lit(10)))


def _both(pairs: DataFrame, table: DataFrame, named: list[str]) -> DataFrame:
    """The rows of both parents under the name of the composition, the columns ``named`` with the parent's prefix."""
    out = []
    for parent, prefix in (("a", FIRST), ("b", SECOND)):
        own = pairs.select("task", F.col(parent).alias("_of")).join(table.withColumnRenamed("task", "_of"), "_of").drop("_of")
        out.append(own.withColumns({c: F.concat(F.lit(prefix), F.col(c)) for c in named}))
    return out[0].unionByName(out[1])


def grafted(joins: DataFrame, nodes: DataFrame, ports: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compositions of two tasks by an edge from an output of the first to an input of the second: task table, nodes, ports, edges.

    ``joins``: a, b, from_node, from_port, to_node, to_port. ``nodes``: task, node and more; ``ports``: task, node, port,
    is_output, literal, source, grounding; ``edges``: task, edge, from_node, from_port, to_node, to_port, kind. All ids are texts. The input that
    the edge feeds loses its literal and is grounded in what feeds it. A task is not joined with itself.
    """
    src, dst = F.concat(F.lit(FIRST), "from_node"), F.concat(F.lit(SECOND), "to_node")
    pairs = joins.where("a <> b").distinct().withColumns({"src": src, "dst": dst})
    text = F.concat("a", F.lit("|"), "b", F.lit("|"), "src", F.lit("."), "from_port", F.lit("->"), "dst", F.lit("."), "to_port")
    pairs = pairs.withColumn("task", composed_id(None, text))
    fed = pairs.select("task", F.col("dst").alias("node"), F.col("to_port").alias("port"), F.concat(F.lit("derived:"), "src", F.lit(":"), "from_port").alias("_g"))
    all_ports = _both(pairs, ports, ["node"]).join(fed, ["task", "node", "port"], "left")
    hit = F.col("_g").isNotNull() & ~F.col("is_output")
    own = all_ports.withColumns({"literal": F.when(~hit, F.col("literal")), "source": F.when(hit, "upstream").otherwise(F.col("source")), "grounding": F.when(hit, F.col("_g")).otherwise(F.col("grounding"))}).drop("_g")
    new = pairs.select("task", F.concat_ws("_", F.lit("graft"), "src", "dst").alias("edge"), F.col("src").alias("from_node"), "from_port", F.col("dst").alias("to_node"), "to_port", F.lit("data_dependency").alias("kind"))
    return pairs.select("task", "a", "b", F.lit("grafting").alias("operator")), _both(pairs, nodes, ["node"]), own, _both(pairs, edges, ["from_node", "to_node"]).unionByName(new)


def conditioned(joins: DataFrame, nodes: DataFrame, ports: DataFrame, edges: DataFrame, writes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compositions in which a value of the first task decides whether the second one's first write happens: as ``grafted``.

    ``joins``: a, b, decide (a node of a), produce (its value). ``nodes`` has place and op; a node whose op is in ``writes`` writes. Tasks
    without one, or whose first one has a gate already, give no composition.
    """
    first = nodes.where(F.col("op").isin(writes)).groupBy("task").agg(F.min_by("node", F.struct("place", "node")).alias("gated"))
    gates = ports.where(F.col("port") == GATE).where("not is_output").select("task", F.col("node").alias("gated"))
    open_ = first.join(gates, ["task", "gated"], "left_anti").withColumnRenamed("task", "b")
    pairs = joins.where("a <> b").distinct().join(open_, "b")
    pairs = pairs.withColumns({"task": composed_id("cond", F.concat_ws("|", "a", "b", "decide")), "src": F.concat(F.lit(FIRST), "decide"), "dst": F.concat(F.lit(SECOND), "gated")})
    gate = pairs.select("task", F.col("dst").alias("node"), F.lit(GATE).alias("port"), F.lit(False).alias("is_output"), F.lit(None).cast("string").alias("literal"), F.lit("upstream").alias("source"), F.concat_ws(":", F.lit("derived"), "src", "produce").alias("grounding"))
    new = pairs.select("task", F.concat(F.lit("cond_"), "dst").alias("edge"), F.col("src").alias("from_node"), F.col("produce").alias("from_port"), F.col("dst").alias("to_node"), F.lit(GATE).alias("to_port"), F.lit("control_dependency").alias("kind"))
    return pairs.select("task", "a", "b", F.lit("conditionalization").alias("operator")), _both(pairs, nodes, ["node"]), _both(pairs, ports, ["node"]).unionByName(gate), _both(pairs, edges, ["from_node", "to_node"]).unionByName(new)


def composed_lineage(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """task, sources and prefixes: the tasks that a composition is made of, those of its first parent before those of its second, and what stands in front of their steps.

    ``sources``: task, place, source, prefix of tasks that are compositions themselves; any other task is its own source.
    """
    parents = tasks.select("task", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit(FIRST).alias("own"), F.col("a").alias("parent")), F.struct(F.lit(1).alias("side"), F.lit(SECOND).alias("own"), F.col("b").alias("parent")))).alias("p")).select("task", "p.*")
    each = parents.join(sources.withColumnRenamed("task", "parent"), "parent", "left")
    one = F.struct("side", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("source", "parent").alias("source"), F.concat("own", F.coalesce("prefix", F.lit(""))).alias("prefix"))
    got = each.groupBy("task").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return got.select("task", F.transform("s", lambda x: x["source"]).alias("sources"), F.transform("s", lambda x: x["prefix"]).alias("prefixes"))
