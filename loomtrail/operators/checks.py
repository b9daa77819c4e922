"""Checks of tasks: whether their references are grounded in the data, and whether their structure holds.

Every fault of every task is a row: task, node, code, severity and detail. Tables of references are held against tables of
what exists by anti joins, so the checks cost what the references cost, however large the data are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtrail.operators import graphs, statements
from loomtrail.operators.rubrics import literal_allowed

#: Severities, kinds and sources that are known (fixed values).
ERROR, WARNING, INFO = "error", "warning", "info"
KINDS = ["value_dependency", "control_dependency"]
SOURCES = ["world", "literal", "upstream"]
FREE_APPS = ["unspecified", "files"]


def _issues(rows: DataFrame, code: str, severity: str, *detail: str | Column, node: str = "node") -> DataFrame:
    return rows.select("task", F.col(node).alias("node"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat_ws(" ", *detail).alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def grounding_issues(nodes: DataFrame, refs: DataFrame, ports: DataFrame, queries: DataFrame, texts: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """What a task refers to and the data lack.

    ``nodes``: task, node, app. ``refs``: task, node, kind (reads or writes), table (app.name), column, entity, has_value.
    ``ports``: task, node, port, literal, grounding. ``queries``: task, node, app, name, sql. ``texts``: task, text (the
    instruction). ``columns``: table, column of the data. ``rows``: table, id of the data's rows. An entity is
    ``name:id``, ``name:*`` for any row, or ``derived:node:value``; ids are whole numbers. Column ``rowid`` and ``*`` always exist. A literal must occur in the instruction in one of its spellings; empty ones are not looked at.
    """
    tables = columns.select("table").distinct()
    apps = tables.select(F.split_part("table", F.lit("."), F.lit(1)).alias("app")).distinct()
    parts = [_issues(nodes.where(~F.col("app").isin(FREE_APPS)).join(apps, "app", "left_anti"), "APP_WITHOUT_DATABASE", INFO, "app")]
    known = refs.join(tables, "table", "left_semi")
    parts.append(_issues(refs.join(tables, "table", "left_anti"), "TABLE_UNKNOWN", ERROR, "kind", "table"))
    named = known.where(~F.col("column").isin("rowid", "*"))
    parts.append(_issues(named.join(columns, ["table", "column"], "left_anti"), "COLUMN_UNKNOWN", ERROR, "kind", "table", "column"))
    derived = F.col("entity").startswith("derived:")
    target = known.where(derived).withColumn("_n", F.split_part("entity", F.lit(":"), F.lit(2)))
    parts.append(_issues(target.join(nodes.select("task", F.col("node").cast("string").alias("_n")), ["task", "_n"], "left_anti"), "DERIVED_REF_UNKNOWN", ERROR, "entity"))
    row = known.where(~derived).withColumn("_id", F.regexp_extract("entity", r"\A[^:]*:(.*)\z", 1)).where("_id <> '*'")
    number = F.col("_id").rlike(r"\A[0-9]+\z")
    parts.append(_issues(row.where(~number), "ENTITY_REF_NOT_ROWID", ERROR, "entity"))
    ids = rows.select("table", F.col("id").cast("string").alias("_id"))
    exact = row.where(number).withColumn("_id", F.regexp_replace("_id", r"\A0+(?=[0-9])", ""))
    parts.append(_issues(exact.join(ids, ["table", "_id"], "left_anti"), "ENTITY_MISSING", ERROR, "table", "_id"))
    parts.append(_issues(known.where("kind = 'writes' and not coalesce(has_value, false)"), "WRITE_VALUE_MISSING", ERROR, "table", "column"))
    unbound = F.coalesce(F.col("grounding").startswith("unbound:"), F.lit(False))
    parts.append(_issues(ports.where(unbound), "UNBOUND_INPUT", ERROR, "port", "grounding"))
    literal = ports.where(~unbound & (F.col("literal") != "")).join(texts, "task", "left")
    parts.append(_issues(literal.where(~literal_allowed(F.col("literal"), F.coalesce("text", F.lit("")))), "LITERAL_NOT_IN_INSTRUCTION", ERROR, "port", "literal"))
    parts.append(_issues(queries.join(apps, "app", "left_anti"), "SQL_UNCHECKED", WARNING, "name", "app"))
    used = queries.join(apps, "app", "left_semi").withColumn("_t", F.explode_outer(statements.table_names(F.col("sql"))))
    missing = used.where("_t is not null").withColumn("table", F.concat_ws(".", "app", "_t")).join(tables, "table", "left_anti")
    parts.append(_issues(missing, "SQL_COMPILE_ERROR", ERROR, "name", F.lit("no such table"), "_t"))
    return _all(parts)


def structure_issues(nodes: DataFrame, ports: DataFrame, edges: DataFrame, operations: list[str]) -> DataFrame:
    """What is wrong with tasks as graphs.

    ``nodes``: task, node, op, app. ``ports``: task, node, port, is_output, source, grounding. ``edges``: task, edge,
    from_node, from_port, to_node, to_port, kind. Ids are texts and occur once in a task; edges go from an output to an
    input, which no other edge feeds; an upstream input has an edge, a world or literal one a grounding, an output a
    grounding; no step depends on itself, in however many steps. Each node of a cycle is named with the least node of its cycle.
    """
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    none = F.lit(None).cast("string")
    # one row for a node, a port, an edge and each of its ends, which meet by task: where the tables are dealt by task already, nothing is shuffled
    role = lambda role, key, port, node, x=none, y=none, flag=F.lit(None).cast("boolean"): F.struct(
        *(c.alias(n) for n, c in {"role": F.lit(role), "place": F.lit("port" if role in ("from", "to") else role), "key": key, "key_port": port, "node": node, "x": x, "y": y, "flag": flag}.items()))
    c = F.col
    sides = F.array(role("from", c("from_node"), c("from_port"), c("from_node"), c("edge")), role("to", c("to_node"), c("to_port"), c("to_node"), c("edge")), role("edge", c("edge"), none, c("to_node"), c("kind")))
    rows = nodes.select("task", role("node", c("node"), none, c("node"), c("op"), c("app")).alias("r"))
    rows = rows.union(ports.select("task", role("port", c("node"), c("port"), c("node"), c("source"), c("grounding"), c("is_output")).alias("r"))).union(edges.select("task", F.explode(sides).alias("r")))
    w = Window.partitionBy("task", "place", "key", "key_port")
    named = c("task").isNotNull() & c("key").isNotNull() & c("key_port").isNotNull()  # a null is no port
    has = lambda cond: F.coalesce(F.max(cond).over(w), F.lit(False))
    rows = rows.select("task", "r.*").select("*", F.count("*").over(w).alias("n"), F.min("node").over(w).alias("least"), has((c("role") == "port") & c("flag")).alias("output"), has((c("role") == "port") & ~c("flag")).alias("input"), F.count_if(c("role") == "to").over(w).alias("fed"))
    bad, loose = "INVALID_GROUNDING", "UNBOUND_PORT"
    issue = lambda cond, code, *detail, node="node": F.when(cond, F.struct(c(node).alias("node"), F.lit(code).alias("code"), F.concat_ws(" ", F.lit(detail[0]), *detail[1:]).alias("detail")))
    known = lambda name, values: F.coalesce(c(name).isin(values), F.lit(False))
    into = F.coalesce(~c("flag"), F.lit(False))
    faults = {
        "node": [issue(empty("key"), bad, "node without an id"), issue(c("n") > 1, bad, "duplicate node", "key"), issue(~known("x", operations), bad, "unknown operation", "x"), issue(empty("y"), bad, "no app")],
        "port": [
            issue(into & (c("x") == "upstream") & ~(named & (c("fed") > 0)), loose, "lacks an edge", "key_port"), issue(into & c("x").isin("world", "literal") & empty("y"), bad, "lacks stable grounding", "key_port"),
            issue(into & ~known("x", SOURCES), bad, "invalid source", "key_port"), issue(c("flag") & empty("y"), bad, "lacks grounding", "key_port"),
        ],
        "from": [issue(~(named & c("output")), loose, "source is no output", "x")],
        "to": [issue(~(named & c("input")), loose, "target is no input", "x"), issue(c("fed") > 1, loose, "several producers", "key_port")],
        "edge": [issue(empty("key"), bad, "edge without an id"), issue(c("n") > 1, bad, "duplicate edge", "key", node="least"), issue(~known("x", KINDS), bad, "unknown dependency kind", "key")],
    }
    of_role = reduce(lambda rest, name: F.when(c("role") == name, F.array(*faults[name])).otherwise(rest), faults, F.lit(None))
    found = rows.select("task", F.explode(of_role).alias("i")).where("i is not null").select("task", "i.node", "i.code", F.lit(ERROR).alias("severity"), "i.detail").distinct()
    ends = edges.select("task", *(F.struct("task", F.col(f"{end}_node").alias("node")).alias(end) for end in ("from", "to"))).where("from.node is not null and to.node is not null")
    on = graphs.cycle_members(ends, "from", "to", "task")
    # each kind of fault has a text of its own, so those of cycles are none of the others
    return found.union(_issues(on.select("node.task", "node.node", F.col("component.node").alias("least")), "GLOBAL_CONSTRAINT_UNSAT", ERROR, F.lit("on a cycle with"), "least"))


def verdicts(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """Each task (task) with how many errors and warnings it has, and whether it is valid: without an error."""
    n = issues.groupBy("task").agg(F.count_if(F.col("severity") == ERROR).alias("n_errors"), F.count_if(F.col("severity") == WARNING).alias("n_warnings"))
    out = tasks.select("task").distinct().join(n, "task", "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.withColumn("valid", F.col("n_errors") == 0)
