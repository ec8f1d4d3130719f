"""Keyed state with event-time timers: first sightings that are forgotten, and the stages of a news item's life.

Both run in append mode, and a key's state is a few values that a timer drops, so state holds only keys
that were seen within the time they are remembered for, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # in microseconds, as times are passed
FAR = -(1 << 62)


def _in_order(parts: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """One key's rows of a batch by time, then by the other columns: whole numbers and short texts only."""
    held = pd.concat([p[columns] for p in parts], ignore_index=True).sort_values(columns)
    return [held[c].to_numpy() for c in columns]


class FirstSightings(StatefulProcessor):
    """A row where a key was not seen in the time before that counts from its last first sighting."""

    def __init__(self, remembered: int):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, ids = _in_order(rows, ["at", "id"])
        first = (self.first.get() or (FAR,))[0]
        found = []
        while True:  # from one first sighting to the next; rows between them are skipped
            k = int(np.searchsorted(times, first + self.remembered)) if first != FAR else 0
            if k == len(times):
                break
            first = int(times[k])
            found.append((key[0], first, int(ids[k])))
        if found:
            self.first.update((first,))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((first + self.remembered) // 1000)
            yield pd.DataFrame(found, columns=["key", "at", "id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.first.get()
        if state is not None and (state[0] + self.remembered) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


class NewsStages(StatefulProcessor):
    """The stages of a link: flash or article when first seen, and what timers make of it, until the last one forgets it.

    stages: (name, hours after the first sighting); 'article' is given out for flash news only, as others begin so.
    """

    def __init__(self, flash: list[str], stages: list[tuple[str, int]]):
        self.flash, self.stages = set(flash), stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "at long, flash boolean, given int")

    def _given_out(self, key, at: int, flash: bool, given: int, until: int) -> tuple[list[tuple], int]:
        """The stages after the first ``given`` that begin up to ``until`` (milliseconds), and how many are given out then."""
        due = [(name, at + hours * HOUR) for name, hours in self.stages[given:] if -(-(at + hours * HOUR) // 1000) <= until]
        return [(key[0], name, t) for name, t in due if flash or name != "article"], given + len(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, kinds = _in_order(rows, ["at", "kind"])
        first, flash, given = self.state.get() or (FAR, False, 0)
        life = self.stages[-1][1] * HOUR
        out = []
        while True:
            k = int(np.searchsorted(times, first + life)) if first != FAR else 0
            if k == len(times):
                break
            if first != FAR:  # the life before is over, though not all of its timers have run
                out += self._given_out(key, first, flash, given, 1 << 62)[0]
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
            first, flash, given = int(times[k]), kinds[k] in self.flash, 0
            out.append((key[0], "flash" if flash else "article", first))
            self.state.update((first, flash, given))
            for _, hours in self.stages:
                self.handle.registerTimer(-(-(first + hours * HOUR) // 1000))
        if out:
            yield pd.DataFrame(out, columns=["key", "stage", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        if state is None:
            return
        first, flash, given = state
        due, given = self._given_out(key, first, flash, given, expiredTimerInfo.getExpiryTimeInMs())
        if given == len(self.stages):
            self.state.clear()
        else:
            self.state.update((first, flash, given))
        if due:
            yield pd.DataFrame(due, columns=["key", "stage", "at"])

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Rows (key, at as microseconds, ...) of a stream with a watermark through a processor; append mode."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
