"""Operation state: columns against a loop over events; streams out of order, and with forgetting."""

import datetime as dt
import random

import pandas as pd

from folioscope.streaming import operations as S

BASE = dt.datetime(2024, 1, 1)


def by_loop(now, events):
    """The same state, one event after the other."""
    out = []
    for e in sorted(events, key=lambda e: e["seq"]):
        what = e["status"]
        if (what == "start") == (now is not None):
            out.append((e["seq"], "already exists" if what == "start" else "not found"))
            continue
        if what == "start":
            now = S.State("running", 0, int(e["total"] or 0), e["message"], e["parent"], e["us"], None, 0.0, None)
        elif what == "update":
            current = e["current"] if e["current"] is not None else now.current + (e["increment"] or 0)
            elapsed = (e["us"] - now.start_us) / 1e6
            left = (now.total - current) / (current / elapsed) if now.total > 0 and current > 0 and elapsed > 0 else now.remaining
            now = now._replace(current=current, message=e["message"] or now.message, elapsed=elapsed, remaining=left)
        elif what != "cancelled" or now.status == "running":
            now = now._replace(status=what, end_us=e["us"], elapsed=(e["us"] - now.start_us) / 1e6, message=e["message"] or now.message)
            if what == "completed" and now.total == 0:
                now = now._replace(current=1, total=1)
        out.append((e["seq"], "accepted", now.status, now.current, now.total, now.message, now.parent, now.elapsed, now.remaining))
    return out, now


def some_events(pick, n, seq=0):
    kinds = ["start", "update", "update", "update", "update", "completed", "failed", "cancelled"]
    events = []
    for i in range(n):
        events.append(
            {
                "seq": seq + i, "us": 1_000_000 * (seq + i) + pick.randrange(9), "status": pick.choice(kinds),
                "current": pick.choice([None, None, 3, 8]), "increment": pick.choice([None, 1, 2]), "total": pick.choice([None, 0, 40]),
                "message": pick.choice([None, None, f"m{i}"]), "parent": pick.choice([None, "p"]),
            }
        )
    return events


def plain(row):
    return tuple(None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v for v in row)


def test_columns_are_the_loop_s():
    pick = random.Random(4)
    for _ in range(300):
        now = loop_now = None
        for part in range(3):
            events = some_events(pick, pick.randrange(1, 12), 100 * part)
            want, loop_now = by_loop(loop_now, events)
            out, now = S.applied(now, pd.DataFrame(events).astype(object).sample(frac=1, random_state=part))
            got = [plain(r) for r in out.itertuples(index=False, name=None)]
            assert [g[: len(w)] for g, w in zip(got, want, strict=True)] == [plain(w) for w in want]
            assert plain(now or ()) == plain(loop_now or ())


SCHEMA = "name string, seq long, ts timestamp, status string, current long, increment long, total long, message string, parent string"


def run(spark, tmp_path, batches, **options):
    S.use_state_store(spark)
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in [*batches, [("", 0, BASE + dt.timedelta(days=9), "end of replay", *[None] * 5)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        S.track_operations(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "checkpoint")
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(S.OUTPUT).parquet(str(tmp_path / "out")).orderBy("name", "seq").collect()
    return [(r.name, r.seq, r.outcome, r.status, r.current, r.message) for r in rows]


def event(name, seq, status, second, current=None, increment=None, total=None, message=None):
    return (name, seq, BASE + dt.timedelta(seconds=second), status, current, increment, total, message, None)


def test_events_out_of_order(spark, tmp_path):
    late = [event("a", 4, "update", 4, increment=2), event("a", 5, "completed", 5, message="done"), event("b", 2, "update", 2)]
    early = [event("a", 3, "update", 3, current=7), event("a", 1, "start", 1, total=10), event("b", 6, "start", 6), event("a", 2, "start", 2)]
    assert run(spark, tmp_path, [late, early], delay="1 minute") == [
        ("a", 1, "accepted", "running", 0, None), ("a", 2, "already exists", None, None, None), ("a", 3, "accepted", "running", 7, None),
        ("a", 4, "accepted", "running", 9, None), ("a", 5, "accepted", "completed", 9, "done"), ("b", 2, "not found", None, None, None),
        ("b", 6, "accepted", "running", 0, None),
    ]


def test_names_that_never_start(spark, tmp_path):
    """All that is known of them is missing; a column of missing texts is still one of texts."""
    first = [event("a", 1, "update", 1, current=1), event("a", 2, "failed", 2), event("b", 3, "start", 1), event("c", 4, "update", 1)]
    assert run(spark, tmp_path, [first, [event("c", 5, "completed", 3, message="m")]], delay="1 minute") == [
        ("a", 1, "not found", None, None, None), ("a", 2, "not found", None, None, None),
        ("b", 3, "accepted", "running", 0, None), ("c", 4, "not found", None, None, None), ("c", 5, "not found", None, None, None),
    ]


def test_finished_names_start_anew(spark, tmp_path):
    first = [event("a", 1, "start", 0), event("a", 2, "failed", 1), event("b", 1, "start", 0)]
    other = [event("c", 1, "start", 100)]
    again = [event("a", 3, "start", 200, message="again"), event("a", 4, "update", 201, current=2), event("b", 2, "start", 200)]
    assert run(spark, tmp_path, [first, other, again], delay="1 second", keep_ms=10_000) == [
        ("a", 1, "accepted", "running", 0, None), ("a", 2, "accepted", "failed", 0, None),
        ("a", 3, "accepted", "running", 0, "again"), ("a", 4, "accepted", "running", 2, "again"),
        ("b", 1, "accepted", "running", 0, None), ("b", 2, "already exists", None, None, None),
        ("c", 1, "accepted", "running", 0, None),
    ]
