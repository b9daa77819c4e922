"""The test tables, and the stand-ins of the domain's records that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, tasks: int = 4) -> DataFrame:
    """Rows over four (or ``tasks``) tasks per core by their key: a small file has few row groups, and work that is costly per row would wait for those."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism, key)


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``idx``, the number of an event within its user's run."""
    return table(spark, sf_dir, "events").withColumn("idx", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


#: The same as SQL.
EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)"
