"""Queries over change streams, as batch and as stream, and over source text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import inventory as I
from folioscope.operators import oplog as O
from folioscope.staging import stage, staging_root
from folioscope.streaming import changes as C
from folioscope.streaming import metrics as M
from folioscope.streaming.operations import OUTPUT, track_operations, use_state_store
from folioscope.streaming.sessions import debounced_rows
from workload.fixtures import ORACLE_VIEWS, VIEWS, render_spark
from workload.registry import query

VIEWS["file_events"] = """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'p0' ELSE 'p' || CAST(user_id % 40 AS STRING) END AS project,
  CASE WHEN event_id % 9 = 4 THEN 'notes/' ELSE 'src/' END || 'f' || CAST(event_id % 50 AS STRING) || CASE WHEN event_id % 11 = 0 THEN '.txt' ELSE '.py' END AS path,
  CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'opened' END AS event_type
FROM events
"""
ORACLE_VIEWS["scoped_events"] = """
SELECT * FROM file_events WHERE event_type <> 'opened' AND path LIKE 'src/%.py' AND NOT regexp_matches(path, '(^|/)f1\\.py$')
"""
ORACLE_VIEWS["event_sessions"] = """
SELECT *, max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY project ORDER BY ts, event_id) AS session_start FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY project ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM scoped_events)
"""


def _scoped(events: DataFrame) -> DataFrame:
    return C.intake(events, ["src"], ["f1.py"])


@query("file_event_intake", "SELECT event_id, project, path, event_type FROM scoped_events")
def file_event_intake(spark, sf):
    return _scoped(render_spark(spark, sf, "file_events")).select(
        "event_id", "project", "path", "event_type"
    )


@query("debounced_changes", "SELECT DISTINCT project, epoch_us(session_start) AS session_us, path FROM event_sessions")
def debounced_changes(spark, sf):
    events = _scoped(render_spark(spark, sf, "file_events"))
    return O.debounced(events, 30 * 60, bucket_seconds=6 * 3600).select(
        "project", F.unix_micros(F.col("session_start")).alias("session_us"), "path"
    )


def _as_stream(df: DataFrame, slices: int) -> DataFrame:
    """Replay a table as a file stream: slices in order of time, one micro-batch of four files each."""
    spark = df.sparkSession
    folder = f"{staging_root(spark)}/folioscope/replay-{uuid.uuid4().hex}"
    at = F.unix_micros("ts")
    cuts = df.select(at.alias("at")).approxQuantile("at", [i / slices for i in range(1, slices)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = df.where((at > low) & (at <= high))
        part.repartition(4).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _drain(stream: DataFrame, schema) -> DataFrame:
    """Run a stream over what is there and return the rows it wrote."""
    spark = stream.sparkSession
    base = f"{staging_root(spark)}/folioscope/drain-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query(
    "debounced_changes_stream",
    """
SELECT project, epoch_us(session_start) AS session_us, path FROM (
  SELECT project, session_start, path, max(ts) OVER (PARTITION BY project, session_start) AS last FROM event_sessions)
WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM scoped_events) - INTERVAL 1 HOUR
GROUP BY ALL
""",
)
def debounced_changes_stream(spark, sf):
    events = _scoped(render_spark(spark, sf, "file_events")).select(
        "event_id", "project", "path", F.col("ts").cast("timestamp").alias("ts")
    )
    sessions = C.debounce(_as_stream(events, 3), "30 minutes", "1 hour")
    rows = _drain(sessions, sessions.schema)
    return rows.select("project", F.unix_micros("session_start").alias("session_us"), "path")


@query(
    "debounced_rows_stream",
    """
SELECT project, epoch_us(session_start) AS session_us, path FROM (
  SELECT project, session_start, path, max(ts) OVER (PARTITION BY project, session_start) AS last FROM event_sessions)
WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM scoped_events) - INTERVAL 1 HOUR
GROUP BY ALL
""",
)
def debounced_rows_stream(spark, sf):
    events = _scoped(render_spark(spark, sf, "file_events")).select(
        "event_id", "project", "path", F.col("ts").cast("timestamp").alias("ts")
    )
    use_state_store(spark)
    sessions = debounced_rows(_as_stream(events, 3), 30 * 60, "1 hour")
    rows = _drain(sessions, sessions.schema)
    return rows.select("project", F.unix_micros("session_start").alias("session_us"), "path")


def _replayed_operations(spark, sf) -> DataFrame:
    """The operation log as a stream whose parts come in the wrong order, the last part first.

    The delay spans the log, so no event is too late; an event of no operation, after all others,
    lets the watermark pass them.
    """
    log = render_spark(spark, sf, "op_log").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = (last - first) // 1_000_000 + 60
    after = F.timestamp_micros(F.lit(last + (span + 60) * 1_000_000))
    columns = [c for c in log.columns if c not in ("name", "seq", "ts", "status")]
    empty = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in columns]
    closing = spark.range(1).select(F.lit("").alias("name"), F.col("id").alias("seq"), after.alias("ts"), F.lit("end of replay").alias("status"), *empty)
    folder = f"{staging_root(spark)}/folioscope/replay-{uuid.uuid4().hex}"
    for part in (2, 0, 1):
        log.where(F.pmod(F.floor(F.col("seq") / 50), F.lit(3)) == part).repartition(4).write.mode("append").parquet(folder)
    closing.select(*log.columns).repartition(1).write.mode("append").parquet(folder)
    use_state_store(spark)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    return _drain(track_operations(stream, f"{span} seconds"), OUTPUT).where("name <> ''")


@query(
    "operation_state_stream",
    """
SELECT s.name, s.status, s.current, s.total, s.message, s.parent, round(coalesce(epoch_us(greatest(update_ts, end_time)) - epoch_us(start_time), 0) / 1000000, 4) AS elapsed
FROM op_state s
""",
)
def operation_state_stream(spark, sf):
    rows = _replayed_operations(spark, sf)
    accepted = rows.where("outcome = 'accepted'")
    latest = accepted.groupBy("name").agg(
        F.max_by(F.struct("status", "current", "total", "message", "parent", "elapsed"), "seq").alias("s"),
        F.max("elapsed").alias("elapsed"),
    )
    return latest.select(
        "name", "s.status", "s.current", "s.total", "s.message", "s.parent",
        F.round("elapsed", 4).alias("elapsed"),
    )


@query(
    "operation_rejections_stream",
    """
SELECT o.name, o.seq, CASE WHEN o.status = 'start' THEN 'already exists' ELSE 'not found' END AS outcome
FROM op_log o LEFT JOIN op_starts s ON s.name = o.name
WHERE (o.status = 'start' AND o.seq > s.start_seq) OR (o.status <> 'start' AND (s.start_seq IS NULL OR o.seq < s.start_seq))
""",
)
def operation_rejections_stream(spark, sf):
    rows = _replayed_operations(spark, sf)
    return rows.where("outcome <> 'accepted'").select("name", "seq", "outcome")


# Files that the events name, as they are and as the build state knows them: of fifty, some are new,
# some gone, some changed.
VIEWS["watched_files"] = """
SELECT DISTINCT path, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INT) AS n, TIMESTAMP '2024-01-01 00:00:00' AS mtime FROM file_events
"""
VIEWS["watched_now"] = "SELECT path, CAST(n + n % 2 AS BIGINT) AS size, mtime, 'h' AS hash FROM watched_files WHERE n % 7 <> 0"
VIEWS["watched_before"] = "SELECT path, CAST(n AS BIGINT) AS size, mtime, 'h' AS hash FROM watched_files WHERE n % 5 <> 0"


@query(
    "changes_notified_once",
    """
SELECT DISTINCT (e.event_id % 3)::BIGINT AS batch, w.path, CASE WHEN n % 7 = 0 THEN 'deleted' WHEN n % 5 = 0 THEN 'new' ELSE 'modified' END AS change
FROM scoped_events e JOIN watched_files w ON w.path = e.path
WHERE (n % 7 = 0 AND n % 5 <> 0) OR (n % 7 <> 0 AND (n % 5 = 0 OR n % 2 = 1))
""",
)
def changes_notified_once(spark, sf):
    """The stream is stopped and started again between batches; the second batch loses its commit
    and comes again, but reaches the callback, which appends what it is told, only once."""
    events = _scoped(render_spark(spark, sf, "file_events").withColumn("ts", F.col("ts").cast("timestamp")))
    base = f"{staging_root(spark)}/folioscope/notified-{uuid.uuid4().hex}"

    def run(part: int) -> None:
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
        C.notify_changes(
            spark.readStream.schema(events.schema).parquet(f"{base}/in"),
            lambda: render_spark(spark, sf, "watched_now"),
            lambda: render_spark(spark, sf, "watched_before"),
            [lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{base}/out")],
            f"{base}/checkpoint",
            availableNow=True,
        ).awaitTermination()

    run(0)
    run(1)
    commit = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits/1")
    commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(commit, False)
    run(2)
    return spark.read.schema("path string, change string, batch long").parquet(f"{base}/out")


SCOPE_SQL = """
SELECT 'read' AS stage, 'rows' AS metric, count(*) AS value FROM file_events
UNION ALL SELECT 'read', 'hot', count(*) FILTER (project = 'p0') FROM file_events
UNION ALL SELECT 'scope', 'rows', count(*) FROM scoped_events
UNION ALL SELECT 'scope', 'last_event', max(event_id) FROM scoped_events
"""


@query("stage_metrics", SCOPE_SQL)
def stage_metrics(spark, sf):
    """Counts of each stage of the intake, observed while its result is written."""
    metrics = M.StageMetrics()
    events = metrics.watch(
        render_spark(spark, sf, "file_events"), "read", hot=F.sum((F.col("project") == "p0").cast("int"))
    )
    stage(metrics.watch(_scoped(events), "scope", last_event=F.max("event_id")), "watched-intake")
    return metrics.rows(spark)


@query(
    "watch_counters",
    """
SELECT (event_id % 3)::BIGINT AS batch, 'source' AS stage, 'rows' AS metric, count(*) AS value FROM file_events GROUP BY 1
UNION ALL SELECT (event_id % 3)::BIGINT, 'scope', 'rows', count(*) FROM scoped_events GROUP BY 1
UNION ALL SELECT (event_id % 3)::BIGINT, 'scope', 'last_event', max(event_id) FROM scoped_events GROUP BY 1
""",
)
def watch_counters(spark, sf):
    """What a stream's progress says of each of three batches."""
    events = render_spark(spark, sf, "file_events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{staging_root(spark)}/folioscope/watched-{uuid.uuid4().hex}"
    log = M.ProgressLog()
    spark.streams.addListener(log)
    try:
        for part in range(3):
            events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
            scoped = M.watch_stream(
                _scoped(spark.readStream.schema(events.schema).parquet(f"{base}/in")), "scope", last_event=F.max("event_id")
            )
            running = (
                scoped.writeStream.format("parquet").queryName("intake").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            )
            running.awaitTermination()
        # Reports reach listeners a little after the batch that they are of.
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    return log.rows(spark).where("query = 'intake'").select("batch", "stage", "metric", "value")


VIEWS["source_files"] = '''
SELECT p_partkey AS k, 'pkg_' || CAST(p_size AS STRING) || '/mod_' || CAST(p_partkey AS STRING) || '.py' AS path,
  CASE WHEN p_partkey % 41 = 7 THEN 'def broken(:' || chr(10) ELSE
  '"""Module for ' || p_name || '."""' || chr(10) || 'import os' || chr(10) || 'from pkg_1.mod_0 import a, b' || chr(10) || 'from . import sibling' || chr(10)
  || 'LIMIT = ' || CAST(p_size AS STRING) || chr(10) || 'flag = True' || chr(10)
  || 'class Item' || CAST(p_partkey AS STRING) || '(Base, lib.Other):' || chr(10)
  || CASE WHEN p_size % 3 = 0 THEN '' ELSE '    """An item."""' || chr(10) END
  || '    size: int = 1' || chr(10)
  || '    def run(self, a: int, *rest, key: str = "x", **more) -> list[str]:' || chr(10) || '        return []' || chr(10)
  || '    @property' || chr(10) || '    def label(self):' || chr(10) || '        return "x"' || chr(10)
  || 'async def _fetch(url: "Url" = None):' || chr(10) || '    """Get it."""' || chr(10) || '    def inner():' || chr(10) || '        pass' || chr(10) END AS content
FROM part
'''


def _records(spark, sf):
    files = render_spark(spark, sf, "source_files").select("path", "content")
    return files, I.extract(files)


SYMBOLS_SQL = """
SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '.mod_' || CAST(p_partkey AS VARCHAR) AS module, s.kind, replace(s.name, '#', CAST(p_partkey AS VARCHAR)) AS name,
  replace(s.parent, '#', CAST(p_partkey AS VARCHAR)) AS parent, CASE WHEN s.kind = 'class' AND p_size % 3 = 0 THEN NULL ELSE s.docstring END AS docstring,
  (s.line + CASE WHEN p_size % 3 = 0 AND s.line > 7 THEN -1 ELSE 0 END)::INTEGER AS line_number, s.signature, s.is_async, s.extra
FROM part, (VALUES
  ('class', 'Item#', NULL, 'An item.', 7, NULL, NULL, 'Base, lib.Other'),
  ('method', 'run', 'Item#', NULL, 10, 'run(self, a: int, *rest, **more, key: str) -> list[str]', false, 'a=int,key=str'),
  ('property', 'label', 'Item#', NULL, 13, 'label(self)', false, ''),
  ('function', '_fetch', NULL, 'Get it.', 15, '_fetch(url: Url)', true, 'url=Url'),
  ('function', 'inner', '_fetch', NULL, 17, 'inner()', false, '')) s(kind, name, parent, docstring, line, signature, is_async, extra)
WHERE p_partkey % 41 <> 7
"""


@query("source_symbols", SYMBOLS_SQL)
def source_symbols(spark, sf):
    _, records = _records(spark, sf)
    types = F.array_join(
        F.array_sort(F.transform(F.map_entries("parameter_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","
    )
    return I.symbols_of(records, "demo").select(
        "module", "kind", "name", "parent", "docstring", "line_number", "signature", "is_async",
        F.when(F.col("kind") == "class", F.array_join("base_classes", ", ")).otherwise(types).alias("extra"),
    )


@query(
    "source_modules",
    """
SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '.mod_' || CAST(p_partkey AS VARCHAR) AS name, 'Module for ' || p_name || '.' AS docstring,
  'pkg_' || CAST(p_size AS VARCHAR) AS package_path, CASE WHEN p_size % 3 = 0 THEN 17 ELSE 18 END::INTEGER AS line_count, 'LIMIT=int' AS constants, 'flag=bool' AS variables
FROM part WHERE p_partkey % 41 <> 7
""",
)
def source_modules(spark, sf):
    files, records = _records(spark, sf)
    flat = lambda c: F.array_join(
        F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    ).alias(c)
    return I.modules_of(records, files, "demo").select(
        "name", "docstring", "package_path", "line_count", flat("constants"), flat("variables")
    )


@query(
    "source_imports",
    """
SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '.mod_' || CAST(p_partkey AS VARCHAR) AS module, unnest(['os', 'pkg_1.mod_0']) AS import_name FROM part WHERE p_partkey % 41 <> 7
""",
)
def source_imports(spark, sf):
    return I.imports_of(_records(spark, sf)[1], "demo").select("module", "import_name")


@query(
    "source_from_imports",
    """
SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '.mod_' || CAST(p_partkey AS VARCHAR) AS module, 'pkg_1.mod_0' AS import_name, unnest(['a', 'b']) AS imported FROM part WHERE p_partkey % 41 <> 7
""",
)
def source_from_imports(spark, sf):
    return I.from_imports(I.imports_of(_records(spark, sf)[1], "demo"))


@query(
    "source_parse_errors",
    "SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '/mod_' || CAST(p_partkey AS VARCHAR) || '.py' AS path FROM part WHERE p_partkey % 41 = 7",
)
def source_parse_errors(spark, sf):
    return I.parse_errors(_records(spark, sf)[1]).select("path")
