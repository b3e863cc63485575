"""File-change streams: intake, debounce and confirmation against build state."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions import paths
from folioscope.operators.state import changed_files, diff_snapshots
from folioscope.streaming.ledger import Ledger

EVENT_TYPES = ["modified", "created", "deleted"]
log = logging.getLogger(__name__)


def in_watch_scope(path: Column, source_paths: list[str], exclude: list[str]) -> Column:
    """Python files inside one of the source paths and not excluded; paths are relative."""
    keep = path.endswith(".py") & ~path.startswith("/") & ~path.startswith("../")
    if source_paths and "." not in source_paths:
        inside = F.lit(False)
        for folder in source_paths:
            inside = inside | path.startswith(folder.strip("/") + "/")
        keep = keep & inside
    return keep & ~paths.excluded(path, exclude, "path")


def intake(events: DataFrame, source_paths: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """File events(project, path, event_type, ts) in scope; works on batches and streams."""
    return events.where(
        F.col("event_type").isin(EVENT_TYPES)
        & in_watch_scope(F.col("path"), list(source_paths), list(exclude))
    )


def debounce(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Distinct changed paths per project once nothing happened for ``gap``.

    ``delay`` bounds how late an event may come. Sessions of one micro-batch are merged on the
    map side when spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is set,
    which keeps a busy project from reaching one task event by event.
    """
    sessions = (
        events.withWatermark("ts", delay)
        .groupBy("project", F.session_window("ts", gap).alias("session"))
        .agg(F.collect_set("path").alias("paths"), F.count(F.lit(1)).alias("events"))
    )
    return sessions.select(
        "project",
        F.col("session.start").alias("session_start"),
        F.col("session.end").alias("session_end"),
        "events",
        F.explode("paths").alias("path"),
    )


def confirmed_changes(batch: DataFrame, current: DataFrame, state: DataFrame) -> DataFrame:
    """Paths of a batch that really differ from the build state."""
    touched = batch.select("path").distinct()
    here = current.join(touched, "path", "left_semi")
    known = state.join(touched, "path", "left_semi")
    return changed_files(diff_snapshots(here, known))


def notify_changes(
    changes: DataFrame,
    current: Callable[[], DataFrame],
    state: Callable[[], DataFrame],
    callbacks: list[Callable[[DataFrame, int], None]],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Confirm every debounced batch and hand it to the callbacks; one failing callback does
    not keep the others from running.

    A batch that comes again after a restart passes by the callbacks that it has reached. The entry
    is made once a callback has returned: one that is cut off half-way is called again, with the
    same batch number, which lets it write to a place of that name. Callbacks are known by their
    place in the list, so a restarted stream must be given the same list.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, checkpoint)
        ledger.forget_before(batch_id - 1)
        waiting = [(f"callback-{i}", c) for i, c in enumerate(callbacks) if not ledger.reached(batch_id, f"callback-{i}")]
        if not waiting:
            return
        confirmed = confirmed_changes(batch, current(), state())
        for name, callback in waiting:
            try:
                callback(confirmed, batch_id)
            except Exception:
                log.exception("callback failed for batch %s", batch_id)
            else:
                ledger.enter(batch_id, name)

    return (
        changes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def watch_status(query: StreamingQuery) -> dict:
    """Counters of a running stream."""
    progress = query.lastProgress or {}
    return {
        "is_watching": query.isActive,
        "batch": progress.get("batchId"),
        "input_rows": progress.get("numInputRows"),
        "watermark": (progress.get("eventTime") or {}).get("watermark"),
        "state_rows": sum(s["numRowsTotal"] for s in progress.get("stateOperators", [])),
    }
