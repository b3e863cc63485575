"""Debounced changes with one state row per changed path, so that no session is one value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.streaming.waiting import Waiting

EVENT = pa.schema([("us", pa.int64()), ("path", pa.string())])
OUTPUT = "project string, session_start timestamp, session_end timestamp, events long, path string"
#: Rows that a session is given out in at a time.
ROWS_AT_ONCE = 10_000


class Sessions(StatefulProcessor):
    """Sessions of changes of a project, closed once nothing happened for ``gap_us``.

    Events wait in chunks until the watermark has passed them, so they are taken in order, a piece at a
    time. The open session is its bounds and count, and a map with one entry per changed path; sessions
    that begin and end within a piece never enter the state. A timer is set for the first event that
    waits, and one for the time at which the session would close; a timer that a later event has
    overtaken finds nothing to close.
    """

    def __init__(self, gap_us: int):
        self._gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = Waiting(handle, EVENT, "us")
        self._open = handle.getValueState("open", "start_us long, last_us long, events long")
        self._paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One timer for all rows: each timer reads the list of chunks.
        first = self._waiting.add(rows)
        if first is not None:
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        taken = False
        for due in self._waiting.due(passed):
            taken = True
            yield from self._taken(key[0], due)
        first = self._waiting.first() if taken else None
        if first is not None:
            self._handle.registerTimer(first // 1000 + 1)
        if self._open.exists():
            ends = self._open.get()[1] + self._gap
            if ends <= passed:
                yield from self._closed(key[0])
            else:
                self._handle.registerTimer(-(-ends // 1000))

    def _taken(self, project: str, due: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Take a piece in order: its first session may go on with the open one, its last one stays open."""
        session = (due.us.diff() >= self._gap).cumsum()
        last = session.iloc[-1]
        yield from self._joined(project, due[session == 0])
        if last == 0:
            return
        yield from self._closed(project)
        inner = (session > 0) & (session < last)
        if inner.any():
            yield self._whole(project, due[inner], session[inner])
        yield from self._joined(project, due[session == last])

    def _whole(self, project: str, events: pd.DataFrame, session: pd.Series) -> pd.DataFrame:
        """Rows of sessions that are complete."""
        times = events.us.groupby(session)
        bounds = pd.DataFrame({"start": times.first(), "last": times.last(), "events": times.size()})
        paths = pd.DataFrame({"session": session, "path": events.path}).drop_duplicates().join(bounds, on="session")
        return pd.DataFrame(
            {
                "project": project,
                "session_start": pd.to_datetime(paths.start.to_numpy(), unit="us"),
                "session_end": pd.to_datetime((paths["last"] + self._gap).to_numpy(), unit="us"),
                "events": paths.events.to_numpy(),
                "path": paths.path.to_numpy(),
            }
        )

    def _joined(self, project: str, events: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Add events that belong together to the open session, or close it and open theirs."""
        first, last, before = int(events.us.iloc[0]), int(events.us.iloc[-1]), 0
        if self._open.exists():
            start, until, before = self._open.get()
            if first - until >= self._gap:
                yield from self._closed(project)
                start, before = first, 0
        else:
            start = first
        self._open.update((int(start), last, int(before) + len(events)))
        for path in events.path.unique():
            self._paths.updateValue((path,), (True,))

    def _closed(self, project: str) -> Iterator[pd.DataFrame]:
        start, last, events = self._open.get()
        held: list[str] = []
        for path in self._paths.keys():
            held.append(path[0])
            if len(held) == ROWS_AT_ONCE:
                yield self._rows(project, start, last, events, held)
                held = []
        if held:
            yield self._rows(project, start, last, events, held)
        self._open.clear()
        self._paths.clear()

    def _rows(self, project: str, start: int, last: int, events: int, paths: list[str]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "project": project,
                "session_start": pd.Timestamp(start, unit="us"),
                "session_end": pd.Timestamp(last + self._gap, unit="us"),
                "events": events,
                "path": paths,
            }
        )

    def close(self) -> None:
        pass


def debounced_rows(events: DataFrame, gap_seconds: float = 2.0, delay: str = "10 seconds") -> DataFrame:
    """Distinct changed paths per project once nothing happened for the gap; see ``changes.debounce``.

    For projects of any number of paths: a session is never one row of the state or of a shuffle.
    Rows without a path tell nothing and are left out. Needs ``operations.use_state_store``.
    """
    narrow = events.withWatermark("ts", delay).where(F.col("path").isNotNull())
    return (
        narrow.select("project", "ts", F.unix_micros("ts").alias("us"), "path")
        .groupBy("project")
        .transformWithStateInPandas(Sessions(round(gap_seconds * 1e6)), OUTPUT, outputMode="append", timeMode="EventTime")
    )
