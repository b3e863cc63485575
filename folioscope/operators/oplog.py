"""Operation logs, task results and run metrics.

``op_log(name, seq, ts, status, current, increment, total, message, parent)`` is append-only;
``seq`` orders the events of one operation and is unique within it. ``status`` is one of start,
update, completed, failed, cancelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.operators.joins import lookup_join, one_row
from folioscope.staging import stage

DONE = ["completed", "failed", "cancelled"]


def progress_percentage(current: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.lit(100.0), current / total * 100))


def remaining_seconds(current: Column, total: Column, elapsed: Column) -> Column:
    """Remaining work at the rate so far; null while there is no rate."""
    known = (total > 0) & (current > 0) & (elapsed > 0)
    return F.when(known, (total - current) / (current / elapsed))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def rejected_starts(op_log: DataFrame) -> DataFrame:
    """Starts of operations that exist already, and events of ones that do not exist yet."""
    first = _first_starts(op_log).select("name", "start_seq")
    late = lookup_join(op_log.select("name", "seq", "ts", "status"), first, "name", "left")
    begins = F.col("status") == "start"
    return late.select(
        "name",
        "seq",
        F.when(begins & (F.col("seq") > F.col("start_seq")), "already exists")
        .when(~begins & (F.col("start_seq").isNull() | (F.col("seq") < F.col("start_seq"))), "not found")
        .alias("rejected"),
    ).where(F.col("rejected").isNotNull())


def _first_starts(op_log: DataFrame) -> DataFrame:
    return (
        op_log.where(F.col("status") == "start")
        .groupBy("name")
        .agg(F.min_by(F.struct("seq", "ts", "total", "parent", "message"), "seq").alias("s"))
        .select(
            "name",
            F.col("s.seq").alias("start_seq"),
            F.col("s.ts").alias("start_time"),
            F.col("s.total").alias("start_total"),
            F.col("s.parent").alias("parent"),
            F.col("s.message").alias("start_message"),
        )
    )


def latest_state(op_log: DataFrame) -> DataFrame:
    """State per operation after all its events; the last write wins.

    ``current`` is set or incremented; completing an operation without a total makes it 1 of 1.
    A cancellation counts only for an operation that is not finished. Everything is a mergeable
    aggregate, so an operation with a third of all events is combined before each shuffle; the
    increments after the last setting take a second pass over the staged narrow log.
    """
    columns = ["name", "seq", "ts", "status", "current", "increment", "total", "message", "parent"]
    log = stage(op_log.select(*columns), "op-log")
    starts = stage(_first_starts(log), "starts")
    joined = stage(
        lookup_join(
            log.where(F.col("status") != "start").select(
                "name", "seq", "ts", "status", "current", "increment", "message"
            ),
            starts.select("name", "start_seq", "start_total"),
            "name",
            "inner",
        ).where(F.col("seq") > F.col("start_seq")),
        "op-events",
    )
    fills = (F.col("status") == "completed") & (F.coalesce("start_total", F.lit(0)) == 0)
    sets = F.when(F.col("status") == "update", F.col("current"))
    ends = F.col("status").isin("completed", "failed")
    marks = joined.groupBy("name").agg(
        F.max(
            F.when(sets.isNotNull(), F.struct("seq", sets.cast("bigint").alias("value")))
        ).alias("last_update_set"),
        # Only the first completion fills: afterwards the operation has a total.
        F.min(
            F.when(fills, F.struct("seq", F.lit(1).cast("bigint").alias("value")))
        ).alias("first_fill"),
        F.max(F.when(ends, F.struct("seq", "ts", "status"))).alias("last_end"),
        F.min(F.when(ends, F.col("seq"))).alias("first_end"),
        F.min(F.when(F.col("status") == "cancelled", F.struct("seq", "ts", "message"))).alias(
            "first_cancel"
        ),
        F.max(F.when(F.col("status") == "update", F.struct("seq", "ts"))).alias("last_update"),
        F.max(
            F.when(F.col("message").isNotNull() & (F.col("status") != "cancelled"), F.struct("seq", "message"))
        ).alias("last_message"),
    ).withColumns(
        {
            "last_set": F.greatest("last_update_set", "first_fill"),
            "filled": F.col("first_fill").isNotNull(),
            # A cancellation that came in time may bring the last message.
            "last_message": F.greatest(
                "last_message",
                F.when(
                    F.col("first_cancel.message").isNotNull()
                    & (F.col("first_cancel.seq") < F.coalesce("first_end", F.col("first_cancel.seq") + 1)),
                    F.struct(F.col("first_cancel.seq").alias("seq"), F.col("first_cancel.message").alias("message")),
                ),
            ),
        }
    )
    adds = F.when(
        (F.col("status") == "update")
        & F.col("current").isNull()
        & (F.col("seq") > F.coalesce("set_seq", F.lit(-1))),
        F.col("increment"),
    )
    added = (
        lookup_join(
            joined.where("status = 'update' AND current IS NULL AND increment IS NOT NULL").select(
                "name", "seq", "status", "current", "increment"
            ),
            marks.select("name", F.col("last_set.seq").alias("set_seq")),
            "name",
            "left",
        )
        .groupBy("name")
        .agg(F.sum(adds).alias("added"))
    )
    state = starts.join(marks, "name", "left").join(added, "name", "left")
    current = F.coalesce("last_set.value", F.lit(0)) + F.coalesce("added", F.lit(0))
    total = F.when(F.coalesce("filled", F.lit(False)), 1).otherwise(F.coalesce("start_total", F.lit(0)))
    end = F.coalesce("last_end.ts", "first_cancel.ts")
    seen = F.greatest(F.col("last_update.ts"), end)
    work = state.select(
        "name",
        F.coalesce("last_end.status", F.when(F.col("first_cancel").isNotNull(), "cancelled"), F.lit("running")).alias("status"),
        current.cast("bigint").alias("current"),
        total.cast("bigint").alias("total"),
        F.coalesce("last_message.message", "start_message").alias("message"),
        "parent",
        "start_time",
        end.alias("end_time"),
        F.coalesce(seconds_between(F.col("start_time"), seen), F.lit(0.0)).alias("elapsed"),
        seconds_between(F.col("start_time"), F.col("last_update.ts")).alias("_at_update"),
        "start_total",
    )
    return work.select(
        "name", "status", "current", "total", "message", "parent", "start_time", "end_time", "elapsed",
        progress_percentage(F.col("current"), F.col("total")).alias("progress_percentage"),
        F.when(
            F.col("start_total") > 0,
            remaining_seconds(F.col("current"), F.col("total"), F.col("_at_update")),
        ).alias("estimated_remaining"),
    )


def merged_metadata(op_log: DataFrame) -> DataFrame:
    """Last value per operation and metadata key; the log carries a ``metadata`` map."""
    entries = op_log.select("name", "seq", F.explode("metadata").alias("key", "value"))
    return entries.groupBy("name", "key").agg(F.max_by("value", "seq").alias("value"))


def metadata_maps(merged: DataFrame) -> DataFrame:
    """One map per operation; its size is the number of distinct keys, not of events."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return merged.groupBy("name").agg(F.map_from_entries(pairs).alias("metadata"))


def active(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == "running")


def without_finished(state: DataFrame) -> DataFrame:
    return state.where(~F.col("status").isin(DONE))


def log_summary(state: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    sized = F.col("total") > 0
    one = state.agg(
        F.count(F.lit(1)).alias("total_operations"),
        count("running").alias("running_operations"),
        count("completed").alias("completed_operations"),
        count("failed").alias("failed_operations"),
        count("cancelled").alias("cancelled_operations"),
        F.coalesce(F.sum(F.when(sized, F.col("total"))), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum(F.when(sized, F.col("current"))), F.lit(0)).alias("completed_items"),
    )
    return one.withColumn(
        "overall_progress_percentage",
        F.when(F.col("total_items") > 0, F.col("completed_items") / F.col("total_items") * 100).otherwise(0.0),
    )


def task_durations(results: DataFrame) -> DataFrame:
    """results(id, start, end, error): duration and success; a reversed interval counts zero."""
    return results.withColumns(
        {
            "duration": F.greatest(F.lit(0.0), seconds_between(F.col("start"), F.col("end"))),
            "success": F.col("error").isNull(),
        }
    )


def task_statistics(results: DataFrame) -> DataFrame:
    ok = F.col("success")
    good = F.when(ok, F.col("duration"))
    zero = F.lit(0.0)
    return task_durations(results).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(ok).alias("successful_tasks"),
        F.count_if(~ok).alias("failed_tasks"),
        F.coalesce(F.count_if(ok) / F.count(F.lit(1)), zero).alias("success_rate"),
        F.coalesce(F.sum("duration"), zero).alias("total_processing_time"),
        F.coalesce(F.sum(good), zero).alias("successful_processing_time"),
        F.coalesce(F.sum(good) / F.count_if(ok), zero).alias("average_task_time"),
        F.coalesce(F.max(good), zero).alias("max_task_time"),
        F.coalesce(F.min(good), zero).alias("min_task_time"),
    )


def failed_tasks(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull()).select("id")


def written_files(results: DataFrame) -> DataFrame:
    """Files of successful results; ``files`` is an array per result."""
    return results.where(F.col("error").isNull()).select(F.explode("files").alias("file"))


def run_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
        F.coalesce(F.max("memory_peak"), F.lit(0)).cast("bigint").alias("peak_memory"),
    )


def bottlenecks(metrics: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Metrics above a share of their run's total; ``metrics`` has a ``run`` column.

    The totals are aggregated and joined back instead of a window over the run, which would
    put a whole run into one task.
    """
    totals = metrics.groupBy("run").agg(F.sum("duration").alias("run_duration"))
    narrow = metrics.select("run", "name", "duration")
    share = F.col("duration") / F.col("run_duration")
    return (
        lookup_join(narrow, totals, "run", "inner")
        .where(F.col("duration") > F.col("run_duration") * threshold)
        .select(
            "run",
            "name",
            "duration",
            (share * 100).alias("share"),
            rules.say(
                F.col("name"), ": ", rules.fixed(F.col("duration"), 3), "s (", rules.fixed(share * 100), "% of total)"
            ).alias("message"),
        )
    )


def notable_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics named in the advice: CPU-heavy ones and ones called very often."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("cpu_percent") > 80, "cpu"), F.when(F.col("calls_count") > 10_000, "calls")
        )
    )
    return metrics.select(F.explode(kinds).alias("kind"), "name")


def run_advice(metrics: DataFrame) -> DataFrame:
    """Advice for a run; counts stand for the names, which ``notable_metrics`` lists."""
    heavy, busy = F.col("cpu_percent") > 80, F.col("calls_count") > 10_000
    one = one_row(
        run_totals(metrics),
        metrics.agg(
            F.count_if(heavy).alias("cpu_ops"),
            F.count_if(busy).alias("call_ops"),
        ),
    )
    advice = rules.messages(
        (
            F.col("peak_memory") > 500 * 1024 * 1024,
            F.lit(
                "High memory usage detected (>500MB). Consider implementing "
                "batch processing or streaming for large datasets."
            ),
        ),
        (
            F.col("total_duration") > 30,
            F.lit(
                "Long execution time detected (>30s). Consider implementing "
                "parallel processing or caching strategies."
            ),
        ),
        (
            F.col("cpu_ops") > 0,
            rules.say(
                "CPU-intensive operations detected: ",
                F.col("cpu_ops"),
                ". Consider optimizing algorithms or implementing parallel processing.",
            ),
        ),
        (
            F.col("call_ops") > 0,
            rules.say(
                "High function call counts detected: ",
                F.col("call_ops"),
                ". Consider caching results or optimizing algorithms.",
            ),
        ),
    )
    return rules.as_rows(one, advice)


def sessions(
    events: DataFrame, key: str, gap_seconds: float, bucket_seconds: int = 3600
) -> DataFrame:
    """Add ``session_start`` to events(key, ts, ...): a silence of ``gap_seconds`` ends a session.

    A session needs the order of all events of a key. To keep a hot key out of a single task,
    order is established per (key, time bucket); only one summary row per bucket, the last
    event and the last session start, is ordered per key. An event exactly one gap after the
    previous one opens a new session.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = int(gap_seconds * 1_000_000)
    cut = stage(
        events.withColumn("_us", micros).withColumn(
            "_bucket", F.floor(F.col("_us") / (bucket_seconds * 1_000_000)).cast("bigint")
        ),
        "session-events",
    )
    inside = Window.partitionBy(key, "_bucket").orderBy("_us")
    edges = cut.groupBy(key, "_bucket").agg(F.max("_us").alias("_last"))
    by_key = Window.partitionBy(key).orderBy("_bucket")
    before = edges.withColumn("_previous", F.lag("_last").over(by_key)).drop("_last")
    marked = stage(
        cut.join(before, [key, "_bucket"]).withColumn(
            "_start",
            F.when(
                F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_previous")) < gap,
                F.lit(None),
            ).otherwise(F.col("_us")),
        ).drop("_previous"),
        "session-marks",
    )
    starts = marked.groupBy(key, "_bucket").agg(F.max("_start").alias("_opened"))
    running = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.withColumn("_carried", F.max("_opened").over(running)).drop("_opened")
    so_far = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.join(carried, [key, "_bucket"])
        .withColumn(
            "session_start",
            F.timestamp_micros(F.coalesce(F.max("_start").over(so_far), F.col("_carried"))),
        )
        .drop("_us", "_bucket", "_start", "_carried")
    )


def debounced(events: DataFrame, gap_seconds: float = 2.0, bucket_seconds: int = 3600) -> DataFrame:
    """Distinct changed paths per project and quiet period, as rows."""
    marked = sessions(events.select("project", "path", "ts"), "project", gap_seconds, bucket_seconds)
    return marked.select("project", "session_start", "path").distinct()
