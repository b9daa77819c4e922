"""Sinks: JSON with sorted keys, ragged CSV, lists and reports, bundles, and builds that are never overwritten.

Spark's committer moves finished files into place, so a job that fails leaves no half-written ones behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with its keys in order, at every level of structs."""
    def ordered(c: Column, kind) -> Column:
        if kind.typeName() != "struct":
            return c
        return F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))

    return F.to_json(F.struct(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; an existing target is an error."""
    df.select(sorted_json(df).alias("value")).write.mode("errorifexists").text(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key the JSON lines at ``path`` do not hold yet, so a job may be taken up again."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.select(*key).schema).json(path)
    except Exception as error:  # no such path: the first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = df.select(*key).limit(0)
    df.join(done.distinct(), key, "left_anti").write.mode("append").json(path)


def write_ragged_csv(df: DataFrame, cells: str, columns: list[str], path: str) -> None:
    """CSV with a header from a mapping of cells; what a row lacks is blank, and cells of other columns are left out."""
    df.select(*(F.coalesce(F.col(cells)[c], F.lit("")).alias(c) for c in columns)).write.csv(path, header=True, emptyValue="")


def tsv_lines(df: DataFrame) -> DataFrame:
    """Rows as lines of tab-separated cells; tabs and line feeds within a cell become blanks."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """A table in Markdown as numbered lines, the header first."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    body = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, f"|{' --- |' * len(df.columns)}")], "line long, value string")
    return head.unionByName(body.select((F.monotonically_increasing_id() + 2).alias("line"), "value"))


def write_bundle(df: DataFrame, key: str, path: str) -> DataFrame:
    """One folder of JSON per candidate and a manifest of their rows and digests, which is returned; an existing target is an error."""
    lines = df.select(key, sorted_json(df).alias("value"))
    lines.repartition(key).write.mode("errorifexists").partitionBy(key).text(f"{path}/candidates")
    manifest = lines.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("value", 256))), ""), 256).alias("digest"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def changed_members(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Members of a bundle whose digest is not what the earlier manifest says, or that came or went."""
    a, b = before.select(key, F.col("digest").alias("before")), after.select(key, F.col("digest").alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
