"""Telemetry as streams: the same events, statistics and alarms, with watermarks.

Statistics leave a window only when the watermark has passed its end, so only
completed periods are evaluated; late events within the delay still count.
Transitions are a stateful operator keyed by alarm: its state is the end of the
alarm's last breaching period, and an event-time timer ends the alarm once the
period after that has passed without data. State and timers are in the checkpoint,
so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators import telemetry

TRANSITION = "environment string, stage string, metric string, statistic string, at timestamp, from_state string, to_state string"
_COLUMNS = [c.split()[0] for c in TRANSITION.split(", ")]
_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def statistics(events: DataFrame, delay: str = "2 minutes", period: int = 60) -> DataFrame:
    """Streaming statistics of invocation events (ts of type timestamp) in append mode."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return telemetry.statistics(telemetry.metric_values(timed), period)


def alarm_states(events: DataFrame, alarms: DataFrame, delay: str = "2 minutes", period: int = 60) -> DataFrame:
    """Streaming states, with the time of their window for operators that follow; the alarm table is a static, bounded side."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    stats = telemetry.statistics(telemetry.metric_values(timed), period, timed=True)
    return telemetry.alarm_states(stats, alarms)


class Transitions(StatefulProcessor):
    """OK to ALARM and back for one alarm a key."""

    def __init__(self, period: int):
        self.period = period * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")  # where the last breaching period ends

    def _move(self, until: int | None, to: int | None) -> None:
        """A timer stands where the period after the last breach ends: by then that period's row has come, if there is one."""
        if until is not None:
            self.handle.deleteTimer(until + self.period)
        if to is None:
            self.until.clear()
        else:
            self.until.update((to,))
            self.handle.registerTimer(to + self.period)

    @staticmethod
    def _rows(key: tuple, moves: list[tuple[int, str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, pd.Timestamp(at, unit="ms"), *states) for at, *states in moves], columns=_COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        found = self.until.get()
        before = until = None if found is None else found[0]
        moves = []
        for start, state in sorted(r for batch in rows for r in zip(batch["start"].tolist(), batch["state"].tolist(), strict=True)):
            if until is not None and start >= until and (state != "ALARM" or start > until):
                moves.append((until, "ALARM", "OK"))
                until = None
            if state == "ALARM":
                if until is None:
                    moves.append((start, "OK", "ALARM"))
                until = max(start + self.period, until or 0)
        if until != before:
            self._move(before, until)
        yield self._rows(key, moves)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        found = self.until.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if found is None or found[0] + self.period != due:
            yield self._rows(key, [])
            return
        self.until.clear()
        yield self._rows(key, [(found[0], "ALARM", "OK")])

    def close(self) -> None:
        pass


def transitions(states: DataFrame, period: int = 60, delay: str = "2 minutes") -> DataFrame:
    """OK to ALARM and back, per alarm, as states arrive; a gap after a breach ends it when the watermark has passed.

    The query must be started under ``stored_state``. States without the time of their window get a watermark of their own.
    """
    timed = states if "period_time" in states.columns else states.withColumn("period_time", F.col("period_start")).withWatermark("period_time", delay)
    rows = timed.select("environment", "stage", "metric", "statistic", "period_time", F.unix_millis("period_start").alias("start"), "state")
    return rows.groupBy("environment", "stage", "metric", "statistic").transformWithStateInPandas(Transitions(period), TRANSITION, "Append", "EventTime")


@contextmanager
def stored_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that timers need; the session's own setting comes back after."""
    key, ours = _STORE
    own = spark.conf.get(key, None)
    spark.conf.set(key, ours)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)
