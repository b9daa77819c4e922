"""Task modules: composition, interfaces, literals, labels, search, and what a schema and a world say about them.

Tables are long: nodes (module, node, op), edges (module, a, b), ports (module, node, port, type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.operators.graphs import closure
from loomtrail.operators.texts import slug

# Operations that gather, and such that look something up.
FAN_IN = ["compare", "aggregate", "decide"]
LOOKUP = ["retrieve", "resolve", "filter"]


def composed(nodes: DataFrame, edges: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several modules as one graph: names get their module in front, and bridges (from_module, a, to_module, b) join them."""
    name = lambda m, n: F.concat_ws(".", m, n)
    inner = edges.select(name("module", "a").alias("a"), name("module", "b").alias("b"))
    return nodes.select(name("module", "node").alias("node"), "op"), inner.unionByName(bridges.select(name("from_module", "a").alias("a"), name("to_module", "b").alias("b"))).distinct()


def subgraph(entities: DataFrame, relations: DataFrame, apps: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities (entity, surfaces) that show on one of the applications, and the relations (a, b) between them."""
    kept = entities.where(F.arrays_overlap("surfaces", F.array(*map(F.lit, apps))))
    of = kept.select("entity")
    return kept, relations.join(of.toDF("a"), "a", "left_semi").join(of.toDF("b"), "b", "left_semi")


def beam(candidates: DataFrame, score: str, ident: str, gate: Column, budget: int, width: int) -> DataFrame:
    """The best ``width`` candidates that pass the gate, of the best ``budget`` ones, which alone are checked."""
    order = [F.col(score).desc(), F.col(ident)]
    return candidates.orderBy(*order).limit(budget).where(gate).orderBy(*order).limit(width)


def label(source_op: Column, target_op: Column, depth: Column) -> Column:
    """What joining a node to another one is called; ``depth`` is the longest way to the target from a beginning."""
    both = source_op.isin(LOOKUP) & target_op.isin(LOOKUP)
    return F.when(target_op.isin(FAN_IN), "fan_in_extension").when(both, "motif_repetition").when(depth >= 3, "delayed_reuse").otherwise("typed_grafting")


def downstream_values(values: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Values (node, name, value) of the nodes that changed (node) and of all that follow them."""
    reach = closure(edges, "a", "b").join(changed.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node")
    return values.join(reach.unionByName(changed.select("node")).distinct(), "node", "left_semi")


def lineage(compositions: DataFrame, sources: DataFrame) -> DataFrame:
    """For each composition (id, parents, operator) the sources (id, source) of all its parents, in their order and each once."""
    each = compositions.select("id", "operator", F.posexplode("parents").alias("_i", "_p")).join(sources.select(F.col("id").alias("_p"), "source"), "_p", "left")
    got = each.groupBy("id", "operator").agg(F.array_sort(F.collect_list(F.struct("_i", "source"))).alias("_s"))
    return got.select("id", "operator", F.array_join(F.array_distinct(F.col("_s.source")), ",").alias("sources"))


def profile_score(profiles: DataFrame, weights: dict[str, float], targets: list[str], depths: tuple[int, int], most_nodes: int, most_ratio: float, least_in_target: int) -> DataFrame:
    """Score of each profile (shares of buckets as columns of their names, depth, cross_app, n_nodes, ratio, far_carries, in_target) and why it is rejected."""
    score = sum((F.col(b) * w * (2.0 if b in targets else 0.5) for b, w in weights.items()), F.lit(0.0))
    low, high = depths
    outside = F.greatest(F.lit(low) - F.col("depth"), F.col("depth") - high, F.lit(0))
    reasons = {"INDEPENDENT_COMPONENTS": F.col("ratio") > most_ratio, "DECORATIVE_CARRY": F.col("far_carries") > 0, "NO_NODE_IN_TARGET_BUCKET": F.col("in_target") < least_in_target, "TOO_MANY_NODES": F.col("n_nodes") > most_nodes}
    return profiles.select("id", F.round(score - 0.1 * outside + 0.05 * F.col("cross_app"), 4).alias("score"), F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items()))), ",").alias("rejections"))


def port_types(ports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per module its ports, how many are under another name than the registry's (alias, canonical), and the types that are not registered."""
    both = ports.join(aliases.select(F.col("alias").alias("type"), "canonical"), "type", "left")
    return both.groupBy("module").agg(F.count("*").alias("n_ports"), F.count_if(F.col("canonical") != F.col("type")).alias("n_changed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("canonical").isNull(), F.concat_ws(":", "node", "port", "type")))), ",").alias("unregistered"))


def class_breaches(nodes: DataFrame, effects: DataFrame, ranks: list[str], changing: list[str]) -> DataFrame:
    """Nodes (node, op, declared) whose declared class is not the greatest of their effects (node, class), or that have effects though their op changes nothing."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ranks)), c)
    most = effects.groupBy("node").agg(F.max(rank(F.col("class"))).alias("_m"))
    both = nodes.join(most, "node", "left")
    fault = F.when(F.col("_m").isNotNull() & ~F.col("op").isin(changing), "effects of a reading node").when(F.coalesce("_m", F.lit(1)) != rank(F.col("declared")), "declared otherwise")
    return both.select("node", fault.alias("fault")).where("fault is not null")


def interface_breaches(public: DataFrame, ports: DataFrame) -> DataFrame:
    """Public ports (module, node, port, type) that do not exist or are of another type."""
    both = public.join(ports.withColumnRenamed("type", "_t"), ["module", "node", "port"], "left")
    return both.select("module", "node", "port", F.when(F.col("_t").isNull(), "missing").when(F.col("_t") != F.col("type"), "type").alias("fault")).where("fault is not null")


def ungrounded(inputs: DataFrame, entities: DataFrame) -> DataFrame:
    """Inputs (node, source, name) from the world that name no entity."""
    return inputs.where("source = 'world'").join(entities.select(F.col("entity").alias("name")), "name", "left_anti").select("node", "name")


def literal_ports(ports: DataFrame, excluded: DataFrame) -> DataFrame:
    """Ports that hold a literal, but for literals that are excluded, whatever the case."""
    return ports.where("literal is not null").withColumn("_l", F.lower("literal")).join(excluded.select(F.lower("literal").alias("_l")).distinct(), "_l", "left_anti").drop("_l")


def literals_in_order(ports: DataFrame, by: str, at: str) -> DataFrame:
    """The literals of each task in the order of their first occurrence."""
    first = ports.where("literal is not null").groupBy(by, "literal").agg(F.min(at).alias("_at"))
    return first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_at", "literal"))).alias("_l")).select(by, F.array_join("_l.literal", "|").alias("literals"))


def read_facts(reads: DataFrame) -> DataFrame:
    """Facts (table, column, entity) of reads (task, table, columns, entities), each once."""
    return reads.select("task", "table", F.explode("columns").alias("column"), "entities").select("task", "table", "column", F.explode("entities").alias("entity")).distinct()


def agents(*manifests: DataFrame) -> DataFrame:
    """All agents that any manifest (agent) names."""
    out = manifests[0].select("agent")
    for m in manifests[1:]:
        out = out.union(m.select("agent"))
    return out.where("agent is not null").distinct()


def review_sheet(records: DataFrame, task: str, order: list[str], codes: list[str]) -> DataFrame:
    """The latest record of each task, if its code is one of those to review."""
    last = records.groupBy(task).agg(F.max(F.struct(*order, "code")).alias("_r"))
    return last.select(task, F.col("_r.code").alias("code"), *(F.col(f"_r.{c}").alias(c) for c in order)).where(F.col("code").isin(codes))


def failing(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tasks without a verdict auto_validated."""
    return tasks.select("task").join(verdicts.where("verdict = 'auto_validated'").select("task").distinct(), "task", "left_anti")


def typed_texts(params: DataFrame, names: list[str], least: int = 3) -> DataFrame:
    """Parameters that hold typed text: of the given names, trimmed, of ``least`` characters or more."""
    return params.where(F.col("name").isin(names)).withColumn("value", F.trim("value")).where(F.length("value") >= least)


def schema_lines(columns: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """A line per table with its rows (table, n), columns (table, column, type, position) and keys (from_table, from_column, to_table)."""
    cols = columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "column", "type").alias("c")))).alias("_c"))
    fk = keys.groupBy(F.col("from_table").alias("table")).agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "from_column", "to_table"))).alias("_k"))
    line = F.concat("table", F.lit(" ("), "n", F.lit(" rows): "), F.array_join("_c.c", ", "), F.when(F.col("_k").isNotNull(), F.concat(F.lit("; "), F.array_join("_k", ", "))).otherwise(""))
    return cols.join(rows, "table").join(fk, "table", "left").select("table", line.alias("line"))


def sql_tables(sql: Column) -> Column:
    """Names behind FROM and then those behind JOIN in a statement, each once, in their order."""
    names = lambda word: F.regexp_extract_all(sql, F.lit(rf'(?i)\b{word}\s+"?([A-Za-z_][A-Za-z0-9_]*)"?'), 1)
    return F.array_distinct(F.filter(F.concat(names("from"), names("join")), lambda n: F.lower(n) != "select"))


def entity_id(kind: Column, fields: list[Column], fallback: Column) -> Column:
    """kind:name from the fields that are there and not empty, else from the fallback."""
    present = F.array_join(F.filter(F.array(*fields), lambda f: f.isNotNull() & (f != "")), " ")
    return F.concat_ws(":", slug(kind), slug(F.when(present != "", present).otherwise(fallback)))
