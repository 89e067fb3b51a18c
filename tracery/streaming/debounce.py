"""Debounce of live events by the clock: a burst is told once, when nothing has come for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: milliseconds without an event that end a burst.
GAP = 250
#: Rows of a burst that are told at once.
ROWS = 10_000

BURSTS = "root string, burst long, path string, events long"


class Debounce(StatefulProcessor):
    """Holds for each root the paths of the burst that goes on, in the state store, and one timer."""

    def __init__(self, gap: int = GAP) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "events long")
        self.number = handle.getValueState("number", "burst long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = False
        for frame in rows:
            for path, n in frame["path"].value_counts().items():
                before = self.paths.getValue((path,))
                self.paths.updateValue((path,), ((before[0] if before else 0) + int(n),))
                came = True
        if came:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        burst = (self.number.get()[0] if self.number.exists() else 0) + 1
        held = [(key[0], burst, path, events) for (path,), (events,) in self.paths.iterator()]
        # All state is changed before anything is handed on: what is yielded may be asked for under another key.
        self.paths.clear()
        self.number.update((burst,))
        return iter([pd.DataFrame(held[k : k + ROWS], columns=["root", "burst", "path", "events"]) for k in range(0, len(held), ROWS)])

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap: int = GAP) -> DataFrame:
    """T1. Rows (root, burst, path, events) of a stream of events (root, path): the paths of a burst with how often each
    came, once nothing has come under their root for `gap` milliseconds of the clock. Bursts of a root are counted from 1.

    The burst that goes on, and its timer, are state: they outlive the query. A query takes up where its checkpoint
    ends, and a burst whose time has run out meanwhile is told at once. Needs a state store that has timers
    (spark.sql.streaming.stateStore.providerClass of RocksDB), and a trigger of processing time shorter than the gap;
    a trigger tells what has run out by its own clock. A task holds the distinct paths of the bursts that it tells. Events without root or path are no events.
    """
    real = events.where("root is not null and path is not null").select("root", "path")
    return real.groupBy("root").transformWithStateInPandas(statefulProcessor=Debounce(gap), outputStructType=BURSTS, outputMode="Append", timeMode="ProcessingTime")
