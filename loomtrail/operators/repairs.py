"""Repair of value edges between the steps of a task.

Edges carry a value from a port of one step to an input of another. An edge may name an input of its source step instead
of an output; such an edge passes on what that input got. Ports that pass on form pointers, which stay within a task.
Those of tasks that fit are followed in one pass, many tasks at a time; in larger ones pointer jumping follows all of them
at once, so a chain of n links takes log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.operators.graphs import prepare_checkpoints

#: Ports of a task that are followed in one pass at most; as many and one task more are in memory at once.
CHUNK = 1 << 18
#: Tasks per core that rows are spread over, so that what one of them sorts stays small.
TASKS = 8

#: What happens to an edge (fixed values).
DROPPED, COPIED, REWIRED, KEPT = "dropped_self_edge", "literal_copied", "rewired_to_producer", "kept"


def follow_pointers(pointers: DataFrame) -> DataFrame:
    """The end of each pointer's chain, and how many links away it is; rows whose chain ends in a circle have none.

    Takes (at, to), one row per ``at``, both of one type, none of them null. Gives (at, end, hops).
    """
    prepare_checkpoints(pointers.sparkSession)
    own = pointers.select("at", "to")
    ends = own.select("to").distinct().join(own.select(F.col("at").alias("to")), "to", "left_anti").withColumn("last", F.lit(True))
    state = own.join(ends, "to", "left").select("at", "to", F.lit(1).cast("long").alias("hops"), F.coalesce("last", F.lit(False)).alias("done")).checkpoint()
    open_ = state.where("not done").count()
    while open_:
        # an open row points to a row with a pointer of its own: take that one's target
        ahead = state.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = state.where("not done").join(ahead, "to").select("at", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        state = state.where("done").union(moved).checkpoint()
        left = state.where("not done").count()
        if left == open_:  # of any open chain with an end some row gets there in each round: what is left runs in circles
            break
        open_ = left
    return state.where("done").select("at", F.col("to").alias("end"), "hops")


def _followed(rows: pa.Table) -> pa.Table:
    """The places of whole tasks with where their value comes from: ``rows`` with the end of each pointer in the place of its target, and hops and literal of that end.

    Pointers have a to_node, other rows a literal. Pointers whose chain ends in a circle are left out.
    """
    n = len(rows)
    code = np.zeros(2 * n, dtype=np.int64)
    for at, to in (("task", "task"), ("node", "to_node"), ("port", "to_port")):
        both = pa.chunked_array([*rows[at].chunks, *rows[to].chunks], rows[at].type).combine_chunks().dictionary_encode("encode")
        own = both.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (len(both.dictionary) + 1) + own, return_inverse=True)[1]
    at, to = code[:n], code[n:]
    pointer = rows["to_node"].is_valid().to_numpy()
    links = np.full(2 * n, -1, dtype=np.int64)
    links[at[pointer]] = np.flatnonzero(pointer)
    literals = np.full(2 * n, -1, dtype=np.int64)
    literals[at[~pointer]] = np.flatnonzero(~pointer)
    last, hops, ahead = np.arange(n), pointer.astype(np.int64), np.where(pointer, links[to], -1)
    left = -1
    while (rest := np.flatnonzero(ahead >= 0)).size not in (0, left):  # what no longer gets less runs in circles
        left, over = rest.size, ahead[rest]
        last[rest], hops[rest], ahead[rest] = last[over], hops[rest] + hops[over], ahead[over]
    keep = np.flatnonzero(ahead < 0)
    end = np.where(pointer, literals[to[last]], np.arange(n))[keep]
    out = rows.select(["task", "node", "port"]).take(keep)
    ends = rows.select(["to_node", "to_port"]).take(last[keep])
    literal = rows["literal"].take(pa.array(end, mask=end < 0))
    return pa.table([*out.columns, *ends.columns, literal, pa.array(hops[keep])], names=["task", "node", "port", "to_node", "to_port", "literal", "hops"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows pointers of whole tasks, of which each one's rows come behind each other."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            rows = pa.Table.from_batches(held)
            tasks = batch["task"]
            code = tasks.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change = np.flatnonzero(code != code[-1])
            if change.size:  # the last task may go on
                cut = n - len(batch) + int(change[-1]) + 1
                yield from _followed(rows.slice(0, cut)).to_batches()
                held, n = rows.slice(cut).to_batches(), n - cut
    if held:
        yield from _followed(pa.Table.from_batches(held)).to_batches()


def _sources(places: DataFrame, ports: DataFrame, task: str, spread: Callable[..., DataFrame]) -> DataFrame:
    """Where the values of ``places`` (task, node, port, literal, to_node, to_port) come from in the end."""
    t = {f.name: f.dataType.simpleString() for f in places.schema}
    schema = f"task {t[task]}, node {t['node']}, port {t['port']}, to_node {t['to_node']}, to_port {t['to_port']}, literal {t['literal']}, hops bigint"
    large = ports.groupBy(task).count().where(F.col("count") > CHUNK).select(task)
    some = not large.isEmpty()
    fits = places.join(large, task, "left_anti") if some else places
    rows = spread(fits, task).sortWithinPartitions(task).withColumnRenamed(task, "task").select("task", "node", "port", "literal", "to_node", "to_port")
    out = rows.mapInArrow(_follow, schema).withColumnRenamed("task", task)
    if not some:
        return out
    rest = places.join(large, task, "left_semi")
    source = F.struct(F.col(task), F.col("to_node").alias("node"), F.col("to_port").alias("port"))
    ends = follow_pointers(rest.where("to_node is not null").select(F.struct(task, "node", "port").alias("at"), source.alias("to")))
    ends = ends.select(f"at.{task}", "at.node", "at.port", F.col("end.node").alias("to_node"), F.col("end.port").alias("to_port"), "hops")
    literal = rest.where("to_node is null").select(task, "node", "port", "literal")
    found = ends.join(literal.withColumnsRenamed({"node": "to_node", "port": "to_port"}), [task, "to_node", "to_port"], "left")
    return out.unionByName(found).unionByName(literal.withColumn("hops", F.lit(0).cast("long")), allowMissingColumns=True)


def repair_edges(edges: DataFrame, ports: DataFrame, task: str, final: bool = True) -> DataFrame:
    """What becomes of each edge: task, edge, repair, from_node, from_port, to_node, to_port, literal and hops.

    ``edges`` has task, edge, from_node, from_port, to_node, to_port; ``ports`` has task, node, port, is_output and
    literal (null without one), an input and an output of one name being two rows. Edges from a step to itself are
    dropped. An edge whose source port is an output, or no port of its step, is kept. One whose source is an input with
    a literal gives the literal to its target and goes. One whose source is an input that another step feeds is rewired
    to that producer; ``final`` follows producers that pass on themselves to the last one, else one step is taken. If
    several edges feed an input, the one with the greatest id does. An input that its own step feeds, that nothing
    feeds, or that is fed in a circle keeps its edge. With ``final`` a literal at the end of a chain is copied as well.
    Rows with nulls in an edge's ends match no port and are kept.
    """
    n = max(TASKS * edges.sparkSession.sparkContext.defaultParallelism, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda df, *by: df.repartition(n, *by)
    fed = edges.select(task, F.col("to_node").alias("node"), F.col("to_port").alias("port"), F.lit(None).cast("boolean").alias("is_output"), F.lit(None).cast(dict(ports.dtypes)["literal"]).alias("literal"), "edge", F.struct("from_node", "from_port").alias("f"))
    own = ports.select(task, "node", "port", "is_output", "literal", F.lit(None).cast(dict(edges.dtypes)["edge"]).alias("edge"), F.lit(None).cast(fed.schema["f"].dataType).alias("f"))
    p = spread(own.union(fed).where(F.col(task).isNotNull() & F.col("node").isNotNull() & F.col("port").isNotNull()), task)
    p = p.groupBy(task, "node", "port").agg(F.bool_or("is_output").alias("out"), F.max("literal").alias("literal"), F.max_by("f", "edge").alias("f"))
    links = F.col("literal").isNull() & (F.col("f.from_node") != F.col("node"))
    places = p.where("not out").where(F.col("literal").isNotNull() | links)
    places = places.select(task, "node", "port", "literal", *(F.when(links, F.col(f"f.from_{c}")).cast(dict(p.dtypes)[c]).alias(f"to_{c}") for c in ("node", "port")))
    ends = _sources(places, ports, task, spread) if final else places.withColumn("hops", F.lit(1).cast("long"))
    ends = ends.select(task, F.col("node").alias("from_node"), F.col("port").alias("from_port"), F.col("to_node").alias("end_node"), F.col("to_port").alias("end_port"), "literal", "hops")
    all_ = edges.join(spread(ends, task, "from_node", "from_port"), [task, "from_node", "from_port"], "left")
    itself = F.col("from_node") == F.col("to_node")
    value = F.col("literal")
    repair = F.when(itself, DROPPED).when(value.isNotNull(), COPIED).when(F.col("end_node").isNotNull(), REWIRED).otherwise(KEPT)
    out = all_.withColumns({"repair": repair, "literal": F.when(repair == COPIED, value)})
    moved = F.col("repair") == REWIRED
    return out.select(
        task, "edge", "repair", F.when(moved, F.col("end_node")).otherwise(F.col("from_node")).alias("from_node"), F.when(moved, F.col("end_port")).otherwise(F.col("from_port")).alias("from_port"),
        "to_node", "to_port", "literal", F.when(F.col("repair") == REWIRED, F.coalesce("hops", F.lit(0))).when((F.col("repair") == COPIED) & F.col("end_node").isNotNull(), F.col("hops")).otherwise(0).cast("long").alias("hops"),
    )


def repaired_inputs(ports: DataFrame, repaired: DataFrame, task: str) -> DataFrame:
    """The inputs after the repair: those of dropped edges are gone, copied literals stand in theirs. Outputs stay as they are."""
    by = repaired.where(F.col("repair").isin(DROPPED, COPIED)).groupBy(task, F.col("to_node").alias("node"), F.col("to_port").alias("port")).agg(F.bool_or(F.col("repair") == DROPPED).alias("gone"), F.max("literal").alias("copied"))
    both = ports.join(by, [task, "node", "port"], "left").where("is_output or gone is null or not gone")
    return both.select(task, "node", "port", "is_output", F.when(F.col("is_output"), F.col("literal")).otherwise(F.coalesce("copied", "literal")).alias("literal"))
