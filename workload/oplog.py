"""Queries over operation logs, task results, run metrics and error logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import errors as E
from folioscope.operators import graph as G
from folioscope.operators import oplog as O
from workload.fixtures import ORACLE_VIEWS, VIEWS, render_spark
from workload.registry import query

VIEWS["op_log"] = """
SELECT 'op_' || CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS STRING) AS name, event_id AS seq, ts,
  CASE WHEN event_type <> 'signup' AND user_id % 5 = 1 AND event_id % 3 <> 0 THEN 'update' ELSE CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
    ELSE CASE WHEN event_id % 97 = 5 THEN 'cancelled' ELSE 'update' END END END AS status,
  CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN event_id % 50 END AS current,
  CASE WHEN event_type = 'click' THEN 1 + event_id % 3 END AS increment,
  CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 4 = 0 THEN 0 ELSE 40 + user_id % 100 END END AS total,
  CASE WHEN event_id % 5 = 0 THEN 'note ' || CAST(event_id AS STRING) END AS message,
  CASE WHEN event_type = 'signup' AND user_id % 3 <> 0 THEN 'op_' || CAST(user_id - user_id % 3 AS STRING) END AS parent
FROM events
"""
# Trees of five thousand operations, four thousand deep, with a side branch every fifty.
VIEWS["operations"] = """
SELECT 'o_' || CAST(event_id AS STRING) AS name,
  CASE WHEN event_id % 5000 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 'o_' || CAST(event_id - 11 AS STRING)
    WHEN event_id % 50 > 40 THEN 'o_' || CAST(event_id - event_id % 50 + 40 AS STRING) ELSE 'o_' || CAST(event_id - 1 AS STRING) END AS parent
FROM events
"""
VIEWS["task_results"] = """
SELECT 't_' || CAST(event_id AS STRING) AS id, ts AS start,
  ts + CAST(CAST(floor(value * 1000) AS BIGINT) * (CASE WHEN event_id % 40 = 0 THEN -1 ELSE 1 END) AS BIGINT) * INTERVAL '0.001' SECOND AS end_at,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_id
FROM events
"""
VIEWS["run_metrics"] = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'run_0' ELSE 'run_' || CAST(event_id // 4 AS STRING) END AS run,
  'm_' || CAST(event_id AS STRING) AS name, CAST(CAST(floor(value * 100) AS BIGINT) AS DOUBLE) / 128 AS duration,
  CAST(event_id * 60000 AS BIGINT) AS memory_peak, CAST(event_id % 101 AS DOUBLE) AS cpu_percent, event_id * 3 AS calls_count
FROM events
"""
VIEWS["run_metrics"] = VIEWS["run_metrics"].replace("event_id // 4", "(event_id - event_id % 4)")
VIEWS["error_log"] = """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'OSError' WHEN 1 THEN 'FileNotFoundError' WHEN 2 THEN 'OSError' WHEN 3 THEN 'PermissionError'
    WHEN 4 THEN 'ModuleNotFoundError' WHEN 5 THEN 'ImportError' WHEN 6 THEN 'ValueError' WHEN 7 THEN 'KeyError' WHEN 8 THEN 'MemoryError'
    WHEN 9 THEN 'TimeoutError' ELSE 'RuntimeError' END AS exc_type,
  CASE event_id % 11 WHEN 0 THEN '[Errno 2] No such file or directory: x' WHEN 1 THEN 'gone' WHEN 2 THEN '[Errno 13] Permission denied: y' WHEN 3 THEN 'no'
    WHEN 4 THEN 'No module named ''pkg' || CAST(event_id % 7 AS STRING) || '''' WHEN 5 THEN 'cannot import' WHEN 6 THEN 'Sphinx broke'
    WHEN 7 THEN 'bad configuration value' WHEN 8 THEN 'full' WHEN 9 THEN 'slow'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'Obsidian vault ' ELSE 'plain ' END || repeat('long message ', 12) || CAST(event_id % 13 AS STRING) END AS message,
  CASE WHEN event_id % 4 = 1 THEN 'sphinx_build' END AS operation
FROM events WHERE event_type = 'error'
"""

ORACLE_VIEWS["op_starts"] = """
SELECT name, min(seq) AS start_seq, arg_min(ts, seq) AS start_time, arg_min(total, seq) AS start_total, arg_min_null(parent, seq) AS parent, arg_min_null(message, seq) AS start_message
FROM op_log WHERE status = 'start' GROUP BY name
"""
ORACLE_VIEWS["op_events"] = """
SELECT o.*, s.start_seq, s.start_total, min(CASE WHEN o.status IN ('completed', 'failed', 'cancelled') THEN o.seq END) OVER (PARTITION BY o.name) AS first_done,
  CASE WHEN o.status = 'completed' AND s.start_total = 0
      AND row_number() OVER (PARTITION BY o.name, o.status ORDER BY o.seq) = 1 THEN 1 WHEN o.status = 'update' THEN o.current END AS set_value
FROM op_log o JOIN op_starts s ON s.name = o.name WHERE o.status <> 'start' AND o.seq > s.start_seq
"""
ORACLE_VIEWS["op_state"] = """
SELECT s.name, s.parent, s.start_time,
  coalesce(m.end_status, CASE WHEN m.cancel_ts IS NOT NULL THEN 'cancelled' END, 'running') AS status,
  (coalesce(m.set_value, 0) + coalesce((SELECT sum(e.increment) FROM op_events e WHERE e.name = s.name AND e.status = 'update' AND e.current IS NULL
     AND e.seq > coalesce(m.set_seq, -1)), 0))::BIGINT AS current,
  (CASE WHEN m.filled THEN 1 ELSE s.start_total END)::BIGINT AS total,
  coalesce(m.message, s.start_message) AS message,
  coalesce(m.end_ts, m.cancel_ts) AS end_time, m.update_ts, s.start_total
FROM op_starts s LEFT JOIN (
  SELECT name, max(seq) FILTER (set_value IS NOT NULL) AS set_seq, arg_max(set_value, seq) FILTER (set_value IS NOT NULL) AS set_value,
    arg_max(status, seq) FILTER (status IN ('completed', 'failed')) AS end_status, arg_max(ts, seq) FILTER (status IN ('completed', 'failed')) AS end_ts,
    arg_min(ts, seq) FILTER (status = 'cancelled') AS cancel_ts, arg_max(ts, seq) FILTER (status = 'update') AS update_ts,
    arg_max(message, seq) FILTER (message IS NOT NULL AND (status <> 'cancelled' OR seq = first_done)) AS message,
    bool_or(status = 'completed' AND start_total = 0) AS filled
  FROM op_events GROUP BY name) m ON m.name = s.name
"""


def _state(spark, sf):
    return O.latest_state(render_spark(spark, sf, "op_log"))


@query(
    "operation_state",
    """
SELECT name, status, current, total, message, parent,
  CASE WHEN total <= 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, current / total * 100) END AS progress_percentage,
  round(coalesce(epoch_us(greatest(update_ts, end_time)) - epoch_us(start_time), 0) / 1000000, 4) AS elapsed,
  CASE WHEN start_total > 0 AND current > 0 AND epoch_us(update_ts) > epoch_us(start_time)
    THEN round((total - current) / (current / ((epoch_us(update_ts) - epoch_us(start_time)) / 1000000)), 2) END AS estimated_remaining
FROM op_state
""",
)
def operation_state(spark, sf):
    return _state(spark, sf).select(
        "name", "status", "current", "total", "message", "parent", "progress_percentage",
        F.round("elapsed", 4).alias("elapsed"),
        F.round("estimated_remaining", 2).alias("estimated_remaining"),
    )


@query("active_operations", "SELECT name FROM op_state WHERE status = 'running'")
def active_operations(spark, sf):
    return O.active(_state(spark, sf)).select("name")


@query("unfinished_operations", "SELECT name, status FROM op_state WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def unfinished_operations(spark, sf):
    return O.without_finished(_state(spark, sf)).select("name", "status")


@query(
    "operation_summary",
    """
SELECT count(*) AS total_operations, count(*) FILTER (status = 'running') AS running_operations, count(*) FILTER (status = 'completed') AS completed_operations,
  count(*) FILTER (status = 'failed') AS failed_operations, count(*) FILTER (status = 'cancelled') AS cancelled_operations,
  coalesce(sum(total) FILTER (total > 0), 0)::BIGINT AS total_items, coalesce(sum(current) FILTER (total > 0), 0)::BIGINT AS completed_items,
  coalesce(sum(current) FILTER (total > 0) / nullif(sum(total) FILTER (total > 0), 0) * 100, 0.0::DOUBLE) AS overall_progress_percentage
FROM op_state
""",
)
def operation_summary(spark, sf):
    return O.log_summary(_state(spark, sf))


@query(
    "rejected_operation_events",
    """
SELECT o.name, o.seq, CASE WHEN o.status = 'start' THEN 'already exists' ELSE 'not found' END AS rejected
FROM op_log o LEFT JOIN op_starts s ON s.name = o.name
WHERE (o.status = 'start' AND o.seq > s.start_seq) OR (o.status <> 'start' AND (s.start_seq IS NULL OR o.seq < s.start_seq))
""",
)
def rejected_operation_events(spark, sf):
    return O.rejected_starts(render_spark(spark, sf, "op_log"))


@query(
    "operation_metadata",
    """
SELECT name, 'k' || CAST(seq % 4 AS VARCHAR) AS key, arg_max(CAST(seq AS VARCHAR), seq) AS value FROM op_log GROUP BY ALL
""",
)
def operation_metadata(spark, sf):
    log = render_spark(spark, sf, "op_log")
    keyed = log.withColumn(
        "metadata",
        F.create_map(F.concat(F.lit("k"), (F.col("seq") % 4).cast("string")), F.col("seq").cast("string")),
    )
    return O.merged_metadata(keyed)


TREE = """
WITH RECURSIVE t(name, root, depth, parent) AS (
  SELECT name, name, 0, parent FROM operations WHERE parent IS NULL
  UNION ALL SELECT o.name, t.root, t.depth + 1, o.parent FROM operations o JOIN t ON o.parent = t.name)
"""


@query("operation_tree", TREE + "SELECT name, root, depth::INTEGER AS depth, parent FROM t")
def operation_tree(spark, sf):
    return G.operation_tree(render_spark(spark, sf, "operations"))


@query(
    "operation_subtree",
    TREE
    + """, s(name, tree_path) AS (
  SELECT name, name FROM operations WHERE name = 'o_840'
  UNION ALL SELECT o.name, s.tree_path || '/' || o.name FROM operations o JOIN s ON o.parent = s.name)
SELECT name, root, depth::INTEGER AS depth, parent, tree_path FROM t JOIN s USING (name)
""",
)
def operation_subtree(spark, sf):
    return G.operation_tree(render_spark(spark, sf, "operations"), root="o_840")


def _results(spark, sf):
    return render_spark(spark, sf, "task_results").withColumnRenamed("end_at", "end")


ORACLE_VIEWS["durations"] = """
SELECT id, error, greatest(0, (epoch_us(end_at) - epoch_us(start)) / 1000000) AS duration FROM task_results
"""


@query(
    "task_statistics",
    """
SELECT count(*) AS total_tasks, count(*) FILTER (error IS NULL) AS successful_tasks, count(*) FILTER (error IS NOT NULL) AS failed_tasks,
  count(*) FILTER (error IS NULL) / count(*) AS success_rate, round(sum(duration), 3) AS total_processing_time,
  round(sum(duration) FILTER (error IS NULL), 3) AS successful_processing_time, round(avg(duration) FILTER (error IS NULL), 6) AS average_task_time,
  max(duration) FILTER (error IS NULL) AS max_task_time, min(duration) FILTER (error IS NULL) AS min_task_time
FROM durations
""",
)
def task_statistics(spark, sf):
    digits = {"total_processing_time": 3, "successful_processing_time": 3, "average_task_time": 6}
    stats = O.task_statistics(_results(spark, sf))
    return stats.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("failed_tasks", "SELECT id FROM task_results WHERE error IS NOT NULL")
def failed_tasks(spark, sf):
    return O.failed_tasks(_results(spark, sf))


@query(
    "task_durations",
    "SELECT id, duration, error IS NULL AS success FROM durations",
)
def task_durations(spark, sf):
    return O.task_durations(_results(spark, sf)).select("id", "duration", "success")


@query(
    "written_files",
    """
SELECT 'out/' || CAST(event_id AS VARCHAR) || '.md' AS file FROM task_results WHERE error IS NULL
UNION ALL SELECT 'out/index_' || CAST(event_id % 10 AS VARCHAR) || '.md' FROM task_results WHERE error IS NULL
""",
)
def written_files(spark, sf):
    results = _results(spark, sf)
    files = F.array(
        F.concat(F.lit("out/"), F.col("event_id").cast("string"), F.lit(".md")),
        F.concat(F.lit("out/index_"), (F.col("event_id") % 10).cast("string"), F.lit(".md")),
    )
    return O.written_files(results.withColumn("files", files))


@query(
    "run_totals",
    "SELECT sum(duration) AS total_duration, max(memory_peak) AS peak_memory FROM run_metrics",
)
def run_totals(spark, sf):
    return O.run_totals(render_spark(spark, sf, "run_metrics"))


@query(
    "run_bottlenecks",
    """
SELECT m.run, m.name, m.duration, m.duration / t.d * 100 AS share,
  m.name || ': ' || printf('%.3f', m.duration) || 's (' || printf('%.1f', m.duration / t.d * 100) || '% of total)' AS message
FROM run_metrics m JOIN (SELECT run, sum(duration) AS d FROM run_metrics GROUP BY run) t ON t.run = m.run WHERE m.duration > t.d * 0.2
""",
)
def run_bottlenecks(spark, sf):
    return O.bottlenecks(render_spark(spark, sf, "run_metrics"))


@query(
    "notable_metrics",
    "SELECT 'cpu' AS kind, name FROM run_metrics WHERE cpu_percent > 80 UNION ALL SELECT 'calls', name FROM run_metrics WHERE calls_count > 10000",
)
def notable_metrics(spark, sf):
    return O.notable_metrics(render_spark(spark, sf, "run_metrics"))


@query(
    "run_advice",
    """
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, m AS message FROM (
SELECT 0 AS o, CASE WHEN max(memory_peak) > 524288000 THEN 'High memory usage detected (>500MB). Consider implementing batch processing or streaming for large datasets.' END AS m FROM run_metrics
UNION ALL SELECT 1, CASE WHEN sum(duration) > 30 THEN 'Long execution time detected (>30s). Consider implementing parallel processing or caching strategies.' END FROM run_metrics
UNION ALL SELECT 2, CASE WHEN count(*) > 0 THEN 'CPU-intensive operations detected: ' || CAST(count(*) AS VARCHAR) || '. Consider optimizing algorithms or implementing parallel processing.' END FROM run_metrics WHERE cpu_percent > 80
UNION ALL SELECT 3, CASE WHEN count(*) > 0 THEN 'High function call counts detected: ' || CAST(count(*) AS VARCHAR) || '. Consider caching results or optimizing algorithms.' END FROM run_metrics WHERE calls_count > 10000
) WHERE m IS NOT NULL
""",
)
def run_advice(spark, sf):
    return O.run_advice(render_spark(spark, sf, "run_metrics"))


CLASSIFIED = """
SELECT event_id, exc_type, message, operation,
  CASE event_id % 11 WHEN 0 THEN 'file_not_found' WHEN 1 THEN 'file_not_found' WHEN 2 THEN 'permission_denied' WHEN 3 THEN 'permission_denied'
    WHEN 4 THEN 'module_not_found' WHEN 5 THEN 'import_error' WHEN 6 THEN 'sphinx_build_error' WHEN 7 THEN 'configuration_error' WHEN 8 THEN 'memory_error'
    WHEN 9 THEN 'timeout_error' END AS rule_id,
  CASE WHEN event_id % 11 = 8 THEN 'critical' WHEN event_id % 11 = 9 THEN 'warning' ELSE 'error' END AS severity,
  CASE WHEN event_id % 11 < 4 THEN 'file_system' WHEN event_id % 11 < 6 THEN 'dependency' WHEN event_id % 11 = 6 THEN 'sphinx_build' WHEN event_id % 11 = 7 THEN 'configuration'
    WHEN event_id % 11 < 10 THEN 'performance' WHEN operation = 'sphinx_build' THEN 'sphinx_build' WHEN event_id % 2 = 0 THEN 'obsidian_conversion' ELSE 'validation' END AS category
FROM error_log
"""
ORACLE_VIEWS["classified_errors"] = CLASSIFIED


def _classified(spark, sf):
    return E.classify(render_spark(spark, sf, "error_log"))


@query(
    "error_classification",
    """
SELECT event_id, coalesce(rule_id, 'generic_' || exc_type) AS error_kind, severity, category,
  CASE rule_id WHEN 'file_not_found' THEN 'File or Directory Not Found' WHEN 'permission_denied' THEN 'Permission Denied' WHEN 'module_not_found' THEN 'Python Module Not Found'
    WHEN 'import_error' THEN 'Python Import Error' WHEN 'sphinx_build_error' THEN 'Sphinx Documentation Build Failed' WHEN 'configuration_error' THEN 'Configuration Error'
    WHEN 'memory_error' THEN 'Insufficient Memory' WHEN 'timeout_error' THEN 'Operation Timed Out' ELSE exc_type || ': ' || message[1:100] END AS title,
  CASE rule_id WHEN 'file_not_found' THEN 'The system cannot find the specified file or directory: ' || message WHEN 'permission_denied' THEN 'Access denied to file or directory: ' || message
    WHEN 'module_not_found' THEN 'Required Python module ''pkg' || CAST(event_id % 7 AS VARCHAR) || ''' is not installed or available'
    WHEN 'import_error' THEN 'Failed to import required module or component: ' || message WHEN 'sphinx_build_error' THEN 'Sphinx failed to build documentation: ' || message
    WHEN 'configuration_error' THEN 'Invalid or missing configuration: ' || message WHEN 'memory_error' THEN 'Operation failed due to insufficient available memory'
    WHEN 'timeout_error' THEN 'Operation exceeded maximum allowed time: ' || message ELSE message END AS description
FROM classified_errors
""",
)
def error_classification(spark, sf):
    kind = F.regexp_replace("error_id", r"^(generic_.*)_\d{4}$", "$1")
    return _classified(spark, sf).select(
        "event_id", kind.alias("error_kind"), "severity", "category", "title", "description"
    )


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


SUGGESTION_VALUES = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in E.SUGGESTIONS)


@query(
    "error_suggestions",
    f"""
SELECT c.event_id, s.priority::INTEGER AS priority, s.suggestion, replace(s.detail, '{{module}}', 'pkg' || CAST(c.event_id % 7 AS VARCHAR)) AS detail, s.action_type,
  replace(s.command, '{{module}}', 'pkg' || CAST(c.event_id % 7 AS VARCHAR)) AS command
FROM classified_errors c JOIN (VALUES {SUGGESTION_VALUES}) s(category, rule_id, priority, suggestion, detail, action_type, command)
  ON s.category = c.category AND (s.rule_id IS NULL OR s.rule_id = c.rule_id)
""",
)
def error_suggestions(spark, sf):
    return E.suggest(_classified(spark, sf)).select(
        "event_id", "priority", "suggestion", "detail", "action_type", "command"
    )


@query("critical_errors", "SELECT event_id FROM classified_errors WHERE severity = 'critical'")
def critical_errors(spark, sf):
    return E.by_severity(_classified(spark, sf), "critical").select("event_id")


@query("file_system_errors", "SELECT event_id, severity FROM classified_errors WHERE category = 'file_system'")
def file_system_errors(spark, sf):
    return E.by_category(_classified(spark, sf), "file_system").select("event_id", "severity")


@query(
    "error_report",
    """
SELECT 'category' AS "grouping", category AS value, count(*) AS errors, bool_or(severity = 'critical') AS has_critical FROM classified_errors GROUP BY category
UNION ALL SELECT 'severity', severity, count(*), bool_or(severity = 'critical') FROM classified_errors GROUP BY severity
UNION ALL SELECT 'total', 'all', count(*), bool_or(severity = 'critical') FROM classified_errors
""",
)
def error_report(spark, sf):
    return E.error_report(_classified(spark, sf))


@query(
    "error_summary",
    """
SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, bool_or(severity = 'critical') AS has_critical
FROM classified_errors
""",
)
def error_summary(spark, sf):
    return E.error_summary(_classified(spark, sf))


# Waits in rings of five, of which every third is open, with edges from ring to ring; and an acyclic
# graph in which some edges go beside a path of three.
VIEWS["wait_edges"] = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS dep FROM supplier
WHERE NOT (s_suppkey % 5 = 4 AND s_suppkey % 15 < 5)
UNION ALL SELECT a.s_suppkey, b.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey * 2 + 7
"""
VIEWS["layer_edges"] = """
SELECT a.s_suppkey AS source, b.s_suppkey AS target FROM supplier a JOIN supplier b
ON b.s_suppkey IN (a.s_suppkey * 2, a.s_suppkey * 2 + 1, a.s_suppkey * 8 + 5, a.s_suppkey * 3 + 2) AND a.s_suppkey < b.s_suppkey
"""


@query(
    "tasks_in_cycles",
    """
WITH RECURSIVE waits(a, b) AS (
  SELECT id, dep FROM wait_edges UNION SELECT w.a, e.dep FROM waits w JOIN wait_edges e ON e.id = w.b
), stuck AS (
  SELECT x.a AS id, min(x.b) AS component, count(*) AS size FROM waits x JOIN waits y ON y.a = x.b AND y.b = x.a GROUP BY x.a
)
SELECT id, component, size, 'in cycle' AS role FROM stuck
UNION ALL SELECT DISTINCT w.a, NULL::BIGINT, NULL::BIGINT, 'behind' FROM waits w JOIN stuck s ON s.id = w.b WHERE w.a NOT IN (SELECT id FROM stuck)
""",
)
def tasks_in_cycles(spark, sf):
    return G.cycle_report(render_spark(spark, sf, "wait_edges"))


@query(
    "edges_after_full_reduction",
    """
WITH RECURSIVE reached(a, b) AS (
  SELECT source, target FROM layer_edges UNION SELECT r.a, e.target FROM reached r JOIN layer_edges e ON e.source = r.b
)
SELECT source, target FROM layer_edges e
WHERE NOT EXISTS (SELECT 1 FROM layer_edges v JOIN reached r ON r.a = v.target WHERE v.source = e.source AND r.b = e.target)
""",
)
def edges_after_full_reduction(spark, sf):
    return G.reduce_reachable(render_spark(spark, sf, "layer_edges"))
