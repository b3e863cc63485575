"""Rows that wait in a stream's state: no value grows with the rows of a key, and one timer serves them all."""

import random

import pandas as pd
import pytest

from folioscope.streaming import operations, sessions
from test_operation_stream import by_loop, plain, some_events


class Held:
    """One state variable, as a list, value or map; counts rows of the longest list."""

    def __init__(self):
        self.list, self.map, self.longest = [], {}, 0

    def exists(self):
        return bool(self.list)

    def get(self):
        return iter(self.list)

    def put(self, rows):
        self.list = list(rows)

    def appendList(self, rows):
        self.list += rows
        self.longest = max(self.longest, len(self.list))

    def update(self, row):
        self.list = [row]

    def clear(self):
        self.list, self.map = [], {}

    def updateValue(self, key, row):
        self.map[key] = row

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))


class Value(Held):
    def get(self):
        return self.list[0]


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def registerTimer(self, at):
        self.timers.add(at)

    def state(self, name, *_):
        return self.states.setdefault(name, Held())

    getListState = getMapState = state

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def drained(processor, handle, key, batches, watermarks):
    """Gives all batches at once, then lets the watermark go by; returns the pieces given out."""
    list(processor.handleInputRows((key,), iter(batches), Clock(0)))
    assert len(handle.timers) == 1
    assert handle.states["waiting"].longest < sum(len(b) for b in batches) / 20
    out = []
    for ms in watermarks:
        for at in sorted(t for t in handle.timers if t <= ms):
            handle.timers.remove(at)
            out += list(processor.handleExpiredTimer((key,), Clock(ms), None))
    return out


@pytest.mark.parametrize("piece", [50_000, 300])
def test_operations_of_one_busy_name(monkeypatch, piece):
    monkeypatch.setattr("folioscope.streaming.waiting.PIECE", piece)
    monkeypatch.setattr("folioscope.streaming.waiting.GATHERED", 1500)
    monkeypatch.setattr("folioscope.streaming.waiting.CHUNK", 100)
    pick = random.Random(6)
    events = some_events(pick, 4000)
    want, _ = by_loop(None, events)
    mixed = pd.DataFrame(events).sample(frac=1, random_state=6)
    batches = [mixed[i : i + 200] for i in range(0, 4000, 200)]
    handle = Handle()
    processor = operations.OperationStates(None)
    processor.init(handle)
    pieces = drained(processor, handle, "a", batches, [1_500_000, 1_500_001, 4_000_001])
    assert len(pieces) > (2 if piece == 300 else 1) and not handle.states["waiting"].list and not handle.states["waiting_rows"].map
    got = [plain(r)[1:] for r in pd.concat(pieces).itertuples(index=False, name=None)]
    assert [g[: len(w)] for g, w in zip(got, want, strict=True)] == [plain(w) for w in want]


@pytest.mark.parametrize("piece", [50_000, 300])
def test_sessions_of_one_busy_project(monkeypatch, piece):
    monkeypatch.setattr("folioscope.streaming.waiting.PIECE", piece)
    monkeypatch.setattr("folioscope.streaming.waiting.GATHERED", 1500)
    monkeypatch.setattr("folioscope.streaming.waiting.CHUNK", 100)
    pick = random.Random(7)
    times, at = [], 1_000_000
    for _ in range(4000):
        at += pick.choice([10_000] * 60 + [3_000_000])
        times.append((at, f"f{pick.randrange(9)}"))
    want, start, last = [], times[0][0], times[0][0]
    for us, path in times:
        if us - last >= 2_000_000:
            start = us
        last = us
        want.append((start, path))
    mixed = pd.DataFrame(times, columns=["us", "path"]).sample(frac=1, random_state=7)
    handle = Handle()
    processor = sessions.Sessions(2_000_000)
    processor.init(handle)
    batches = [mixed[i : i + 200] for i in range(0, 4000, 200)]
    end = at // 1000 + 2_001
    pieces = pd.concat(drained(processor, handle, "p", batches, [end // 3, end // 2, end]))
    got = list(zip(pieces.session_start.astype("datetime64[us]").astype("int64"), pieces.path, strict=True))
    assert sorted(got) == sorted(set(want))
    counts = {s: sum(s == w for w, _ in want) for s, _ in want}
    assert {(s, n) for (s, _), n in zip(got, pieces.events, strict=True)} == set(counts.items())
