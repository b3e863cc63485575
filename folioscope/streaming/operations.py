"""Operation state as a stream, keyed by operation name, whatever order its events come in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.streaming.waiting import Waiting

STATE = (
    "status string, current long, total long, message string, parent string, start_us long, "
    "end_us long, elapsed double, remaining double"
)
EVENT = pa.schema(
    [
        ("seq", pa.int64()), ("us", pa.int64()), ("status", pa.string()), ("current", pa.int64()), ("increment", pa.int64()),
        ("total", pa.int64()), ("message", pa.string()), ("parent", pa.string()),
    ]
)
OUTPUT = (
    "name string, seq long, outcome string, status string, current long, total long, message string, "
    "parent string, elapsed double, estimated_remaining double"
)
_OUTPUT_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class State(NamedTuple):
    status: str
    current: int
    total: int
    message: str | None
    parent: str | None
    start_us: int
    end_us: int | None
    elapsed: float
    remaining: float | None


def _value(x):
    return None if pd.isna(x) else x


def _kept(values: np.ndarray, given: np.ndarray, before) -> np.ndarray:
    """The last value given up to each place; ``before`` where there is none yet."""
    last = np.maximum.accumulate(np.where(given, np.arange(len(given)), -1))
    out = values[last]
    out[last < 0] = before
    return out


def _longs(values: np.ndarray, missing: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.where(missing, 0, values).astype("int64"), missing)


def applied(now: State | None, events: pd.DataFrame) -> tuple[pd.DataFrame, State | None]:
    """One row per event, in the order of seq, with the state after it; and the last state.

    Columns are computed as wholes: what an event leaves behind is the last value set before it. They are
    plain arrays, since most names have few events.
    """
    seq, us = (events[c].astype("int64").to_numpy() for c in ("seq", "us"))
    order = np.argsort(seq, kind="stable")
    n, seq, us = len(order), seq[order], us[order]
    what, said, parents = (events[c].to_numpy().astype(object)[order] for c in ("status", "message", "parent"))
    set_to, adds, totals = (events[c].to_numpy().astype("float64")[order] for c in ("current", "increment", "total"))
    begins = what == "start"
    first = -1 if now else int(begins.argmax()) if begins.any() else n
    exists = np.arange(n) > first
    outcome = np.where(begins & exists, "already exists", np.where(~begins & ~exists, "not found", "accepted")).astype(object)
    accepted = outcome == "accepted"
    if now is None and first < n:
        total = _value(totals[first])
        now = State("running", 0, int(total or 0), _value(said[first]), _value(parents[first]), int(us[first]), None, 0.0, None)
    # Texts are objects, also where all are missing: a column of missing numbers is no text.
    status, message, parent = (np.full(n, None, object) for _ in range(3))
    current, total, elapsed, left = (np.full(n, np.nan) for _ in range(4))
    if now is not None:
        parent[accepted] = now.parent
        if first >= 0:
            status[first], current[first], total[first], message[first], elapsed[first] = now.status, now.current, now.total, now.message, 0.0
        at = np.flatnonzero(accepted & ~begins)
        if len(at):
            after, end = _after(now, what[at], us[at], set_to[at], adds[at], said[at])
            status[at], current[at], total[at], message[at], elapsed[at], left[at] = after
            z = at[-1]
            now = State(
                status[z], int(current[z]), int(total[z]), _value(message[z]), now.parent, now.start_us,
                end, float(elapsed[z]), None if np.isnan(left[z]) else float(left[z]),
            )
    columns = (
        seq, outcome, status, _longs(current, ~accepted), _longs(total, ~accepted), message, parent, elapsed, left,
    )
    return pd.DataFrame(dict(zip(_OUTPUT_COLUMNS[1:], columns, strict=True))), now


def _after(
    now: State, what: np.ndarray, us: np.ndarray, set_to: np.ndarray, adds: np.ndarray, said: np.ndarray
) -> tuple[tuple[np.ndarray, ...], int | None]:
    """Status, current, total, message, elapsed and remaining after each event of a known operation; its end."""
    update, cancel, done = what == "update", what == "cancelled", what == "completed"
    ended = done | (what == "failed")
    # Only the first event that ends an operation can cancel it.
    counts = ended | (cancel & (np.cumsum(ended | cancel) == 1) & (now.status == "running"))
    fills = done & (np.cumsum(done) == 1) & (now.total == 0)
    sets = fills | (update & ~np.isnan(set_to))
    added = np.cumsum(np.where(update & ~sets & ~np.isnan(adds), adds, 0.0))
    current = _kept(np.where(fills, 1.0, set_to), sets, float(now.current)) + added - _kept(added, sets, 0.0)
    total = np.where(np.cumsum(fills) == 0, float(now.total), 1.0)
    touched = update | counts
    elapsed = _kept((us - now.start_us) / 1e6, touched, now.elapsed)
    rated = update & (total > 0) & (current > 0) & (elapsed > 0)
    rate = np.divide(current, elapsed, out=np.ones(len(us)), where=rated)
    left = _kept((total - current) / rate, rated, np.nan if now.remaining is None else now.remaining)
    end = int(us[counts][-1]) if counts.any() else now.end_us
    status = _kept(what, counts, now.status)
    message = _kept(said, touched & ~pd.isna(said), now.message)
    return (status, current, total, message, elapsed, left), end


class OperationStates(StatefulProcessor):
    """Holds events until the watermark has passed them, then applies them in the order of seq.

    Events wait in chunks beside the state; a timer at the first of them releases what is due, a piece
    at a time. Finished operations are forgotten ``keep_ms`` after their end.
    """

    def __init__(self, keep_ms: int | None):
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("operation", STATE)
        self._waiting = Waiting(handle, EVENT, "seq")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One timer for all rows: each timer reads the list of chunks.
        first = self._waiting.add(rows)
        if first is not None:
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        now, taken = None, False
        for events in self._waiting.due(passed * 1000):
            now, taken = now if taken else self._known(), True
            out, now = applied(now, events)
            out.insert(0, "name", key[0])
            yield out
        if taken:
            if now is not None:
                self._state.update(tuple(now))
            first = self._waiting.first()
            if first is not None:
                self._handle.registerTimer(first // 1000 + 1)
        if self._keep_ms is None:
            return
        if not taken:
            now = self._known()
        if now is not None and now.end_us is not None:
            forgotten = now.end_us // 1000 + self._keep_ms
            if forgotten < passed:
                self._state.clear()
            else:
                self._handle.registerTimer(forgotten + 1)

    def _known(self) -> State | None:
        return State(*self._state.get()) if self._state.exists() else None

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which timers need."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def track_operations(op_log: DataFrame, delay: str = "10 seconds", keep_ms: int | None = None) -> DataFrame:
    """One row per event with the state after it, once the watermark has passed the event.

    ``outcome`` is ``accepted``; a second start of a name gives ``already exists`` and an event
    of an unknown name ``not found``, and neither changes the state. Events up to ``delay`` late
    are put in their place; what comes later is dropped. An operation whose events have ended is
    one small row; with ``keep_ms`` it goes that long after its end, and its name may start anew.
    Needs ``use_state_store``.
    """
    events = op_log.withWatermark("ts", delay).select(
        "name", "ts", F.col("seq").cast("long").alias("seq"), F.unix_micros("ts").alias("us"), "status",
        *(F.col(c).cast("long").alias(c) for c in ("current", "increment", "total")), "message", "parent",
    )
    return events.groupBy("name").transformWithStateInPandas(
        OperationStates(keep_ms), OUTPUT, outputMode="append", timeMode="EventTime"
    )
