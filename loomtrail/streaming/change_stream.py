"""The change log as a stream: files of change rows come in, late rows are set aside, states and counts are kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomtrail.streaming.session_end import keep_state_in_rocksdb


def read_changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files of change rows; Spark's offsets take the place of the polled sequence numbers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kept_changes(rows: DataFrame, seq: str = "seq", action: str = "action_index", current: str = "current_index", late: str = "drop") -> DataFrame:
    """Rows that were stamped for the current action. ``late`` is drop, keep or mark; marked rows have a column ``late``."""
    is_late = ~F.col(action).eqNullSafe(F.col(current))
    if late == "keep":
        return rows
    return rows.withColumn("late", is_late) if late == "mark" else rows.where(~is_late)


class _Flags(StatefulProcessor):
    """The last value of a key, and its place."""

    def __init__(self, key: str, order: str, value: str, kind: str) -> None:
        self.key, self.order, self.value, self.kind = key, order, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", f"last string, place {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, place = self.state.get() if self.state.exists() else (None, None)
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        changed = []
        for at, v in zip(pdf[self.order].tolist(), pdf[self.value].astype("string").tolist(), strict=True):
            v = None if pd.isna(v) else v
            changed.append(place is None or v != last)
            if place is None or at >= place:
                last, place = v, at
        self.state.update((last, place))
        yield pd.DataFrame({self.key: pdf[self.key], self.order: pdf[self.order], "changed": changed})

    def close(self) -> None:
        pass


def state_flags(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, changed) of each row: whether its value differs from the last one of the key, over all batches.

    A key's state is its last value and place. Rows of a key that come behind a later one, in a later batch, are
    compared with the last value seen and do not replace it.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return rows.select(key, order, value).groupBy(key).transformWithStateInPandas(_Flags(key, order, value, kinds[order]), f"{key} {kinds[key]}, {order} {kinds[order]}, changed boolean", "Append", "none")


def windowed_counts(rows: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Rows per key and time window, with a watermark so that state is bounded."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), key, "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
