"""Ends of sessions over a stream of their steps: a flag, or a spent budget of steps or of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUDGET = "budget_exhausted"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need a store that spills to disk; the choice is the session's."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ends(StatefulProcessor):
    """State of a session: when it began (ms), its steps, whether its end was given out. A timer fires when its time is spent."""

    def __init__(self, steps: int, seconds: int, keep: int) -> None:
        self.steps, self.spent, self.keep = steps, seconds * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, steps int, ended boolean")

    def _row(self, key: tuple, steps: int, reason: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]], "n_steps": pd.array([steps], "int32"), "reason": [reason], "ended_at": pd.to_datetime([at], unit="ms")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at", "place"], kind="stable")
        began, steps, ended = self.state.get() if self.state.exists() else (None, 0, False)
        if began is None:
            began = int(pdf["at"].iloc[0])
            self.handle.registerTimer(began + self.spent)
        for at, flag in zip(pdf["at"].tolist(), pdf["flag"].tolist(), strict=True):
            if ended:
                break
            if at >= began + self.spent:
                ended = True
                yield self._row(key, steps, BUDGET, began + self.spent)
                break
            steps += 1
            if isinstance(flag, str) or steps >= self.steps:
                ended = True
                yield self._row(key, steps, flag if isinstance(flag, str) else BUDGET, int(at))
        self.state.update((began, steps, ended))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, steps, ended = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= began + self.keep:
            self.state.clear()
            return
        self.handle.registerTimer(began + self.keep)
        if not ended:
            self.state.update((began, steps, True))
            yield self._row(key, steps, BUDGET, began + self.spent)

    def close(self) -> None:
        pass


def session_ends(rows: DataFrame, session: str, time: str, place: str, flag: str, steps: int, seconds: int, lateness: str = "0 seconds", keep: int | None = None) -> DataFrame:
    """One row per session that has ended: session, n_steps, reason and ended_at.

    The reason is the flag of the first step that has one, else ``budget_exhausted`` at the last step of the budget or
    ``seconds`` after the first step, whichever comes first; a flag on the last step counts as a flag. Steps are taken by
    time and place within a batch; rows behind the watermark are dropped, and what comes after a session's end is ignored
    until ``keep`` seconds (ten times the budget if not given) after its first step, when its state is removed. A session
    of which nothing more comes ends by the timer, once the watermark passes it.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    kind = dict(rows.dtypes)[session]
    stream = rows.select(F.col(session).alias("session"), F.col(time).cast("timestamp").alias("time"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(place).alias("place"), F.col(flag).cast("string").alias("flag")).where("time is not null")
    out = stream.withWatermark("time", lateness).groupBy("session").transformWithStateInPandas(_Ends(steps, seconds, keep or 10 * seconds), f"session {kind}, n_steps int, reason string, ended_at timestamp", "Append", "eventTime")
    return out.withColumnRenamed("session", session)
