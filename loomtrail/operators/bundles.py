"""Which files a selection of runs needs, and which copy of a run stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks per core over which the paths of a closure go.
TASKS = 8


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def file_closure(items: DataFrame, roles: list[str], trajectory: str, records: DataFrame, files: DataFrame, sidecar: str, messages: str, agent: str, repaired: str | None = None) -> DataFrame:
    """Every file that selected items need: path, state (required or missing) and role; a file of several roles has the least one.

    ``items`` has a column of paths per role, among them ``trajectory``; ``records``: path of a trajectory, source (the file that
    a row of it came from, with #line=n behind it or not) and agent; ``files``: path of those there are. All roles of an
    item are required, whether or not they are there, but for trajectories: one that is not there is missing, and its rows are not followed. With
    ``repaired``, a column of paths, that trajectory is followed too. Sources that are not there are missing; beside a
    source the file named ``sidecar`` is required if it is there, and ``messages`` is needed where the agent's name contains ``agent``.
    """
    names = sorted({*roles, "repaired", "source", "sidecar", "messages"})
    rank = lambda name: F.lit(names.index(name)).alias("rank")
    tasks = TASKS * files.sparkSession.sparkContext.defaultParallelism
    there = files.select("path").where("path is not null")
    at_hand = there.repartition(tasks, "path").hint("merge")  # texts: small on disk, large as a table in memory
    kept = items.repartition(tasks, trajectory).join(at_hand.withColumnRenamed("path", trajectory), trajectory, "left_semi")
    listed = items.select(F.explode(F.array(*(F.struct(F.col(c).alias("path"), rank(c)) for c in roles))).alias("f")).select("f.path", "f.rank")
    followed = kept.select(F.col(trajectory).alias("path"))
    if repaired:
        again = kept.select(F.col(repaired).alias("path")).where("path is not null")
        listed = listed.union(again.select("path", rank("repaired")))
        followed = followed.union(again.repartition(tasks, "path").join(at_hand, "path", "left_semi"))
    rows = records.select("path", F.regexp_replace("source", r"#line=[0-9]+\z", "").alias("_source"), F.contains(F.lower(F.coalesce("agent", F.lit(""))), F.lit(agent)).alias("_wanted"))
    rows = rows.where("path is not null and _source is not null").repartition(tasks, "path").join(followed.repartition(tasks, "path").hint("merge"), "path", "left_semi")
    # rows are read once: a source brings itself, what lies beside it and the messages along
    near = lambda name: F.concat(_folder(F.col("_source")), F.lit("/" + name))
    sources = rows.groupBy("_source").agg(F.bool_or("_wanted").alias("_wanted")).select(F.explode(F.array(
        F.struct(F.col("_source").alias("path"), rank("source"), F.lit(False).alias("beside")), F.struct(near(sidecar).alias("path"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("beside")),
        F.struct(F.when(F.col("_wanted"), near(messages)).alias("path"), rank("messages"), F.lit(False).alias("beside")),
    )).alias("f")).select("f.*", F.lit(False).alias("there"))
    needed = listed.select("path", "rank", F.lit(False).alias("beside"), F.lit(False).alias("there")).union(sources).union(there.select("path", F.lit(None).cast("int").alias("rank"), F.lit(False).alias("beside"), F.lit(True).alias("there")))
    by = needed.where("path is not null").repartition(tasks, "path").groupBy("path").agg(
        F.min("rank").alias("rank"), F.bool_or("beside").alias("beside"), F.bool_or("there").alias("there"), F.bool_or(F.coalesce(F.col("rank").isin([names.index(r) for r in roles if r != trajectory]), F.lit(False))).alias("always"))
    by = by.withColumn("rank", F.least("rank", F.when(F.col("beside") & F.col("there"), rank("sidecar")))).where("rank is not null")
    return by.select("path", F.when(F.col("there") | F.col("always"), "required").otherwise("missing").alias("state"), F.get(F.array(*map(F.lit, names)), "rank").alias("role"))


def canonical_copies(selection: DataFrame, copies: DataFrame) -> DataFrame:
    """The copy that each run is read from: run, path, n_matches and how it was found (rule); no path if that stays open.

    ``selection``: run, path, sha256; ``copies``: run, path, sha256 of the files there are. The path itself is taken if it
    is there (``path``); else the only copy of the run (``only``), else the only one with the hash asked for (``hash``), else, if all that are left
    hold the same, the one of the least path (``content``).
    """
    own = selection.join(copies.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").select("run", "path", "sha256", F.coalesce("_there", F.lit(False)).alias("exact"))
    of_run = copies.select("run", F.col("path").alias("_p"), F.col("sha256").alias("_h")).distinct()
    per = own.where("not exact").join(of_run, "run", "left").groupBy("run", "path").agg(
        F.count("_p").alias("n"), F.min("_p").alias("least"), F.countDistinct("_h").alias("kinds"),
        F.count_if(F.col("_h") == F.col("sha256")).alias("same"), F.min(F.when(F.col("_h") == F.col("sha256"), F.col("_p"))).alias("least_same"),
    )
    rule = F.when(F.col("n") == 1, "only").when(F.col("same") == 1, "hash").when((F.col("same") > 1) | ((F.col("n") > 1) & (F.col("kinds") == 1)), "content")
    found = per.withColumn("rule", rule).select("run", F.when(F.col("rule") == "only", F.col("least")).when(F.col("same") > 0, F.col("least_same")).when(F.col("rule") == "content", F.col("least")).alias("path"), F.when(F.col("same") > 0, F.col("same")).otherwise(F.col("n")).alias("n_matches"), "rule")
    return own.where("exact").select("run", "path", F.lit(1).cast("long").alias("n_matches"), F.lit("path").alias("rule")).unionByName(found)
