"""Runs followed by their events: when each ended, and which do not end in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.workers import importable

RESULT = "id long, library_id long, outcome string, started_at timestamp, ended_at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunEnds(StatefulProcessor):
    """Of each run (id) its beginning, kept until it ends; a timer says when it is overdue."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "library_id long, started_ms long, overdue boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event"], ascending=[True, False], kind="stable")  # one run's: a beginning and an end
        out = []
        for event, library, at in zip(events["event"], events["library_id"], events["at"]):
            ms = int(at.value // 1_000_000)
            known = self.begun.get() if self.begun.exists() else None
            if event == "started":
                if known is None:
                    self.begun.update((int(library), ms, False))
                    self.handle.registerTimer(ms + 1000 * self.seconds)
            elif known is not None:
                if not known[2]:
                    self.handle.deleteTimer(known[1] + 1000 * self.seconds)
                self.begun.clear()
                out.append((key[0], known[0], "late" if known[2] or ms - known[1] > 1000 * self.seconds else event, pd.Timestamp(known[1], unit="ms"), pd.Timestamp(ms, unit="ms")))
            else:
                out.append((key[0], int(library), "unknown", pd.NaT, pd.Timestamp(ms, unit="ms")))
        if out:
            yield pd.DataFrame(out, columns=["id", "library_id", "outcome", "started_at", "ended_at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.begun.exists():
            library, ms, _ = self.begun.get()
            self.begun.update((library, ms, True))
            yield pd.DataFrame([(key[0], library, "overdue", pd.Timestamp(ms, unit="ms"), pd.NaT)], columns=["id", "library_id", "outcome", "started_at", "ended_at"])

    def close(self) -> None:
        pass


def run_ends(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """id, library_id, outcome, started_at and ended_at of runs, from events (id, library_id, event, at).

    event: started, or how a run ended (ok, failed). A run that ends in time has its own outcome. One that has not ended
    ``seconds`` after it began, by the events' own time and once the watermark has passed that, is overdue; if it ends
    after all, it is late. An end without a beginning is unknown. Only runs that have begun and not ended are kept.
    """
    spark = events.sparkSession
    importable(spark)
    spark.conf.set(PROVIDER, ROCKS)  # the store that keeps timers
    return events.withWatermark("at", late).groupBy("id").transformWithStateInPandas(RunEnds(seconds), RESULT, "Append", "EventTime")
