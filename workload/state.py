"""Queries over snapshots, rebuild planning and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import paths
from folioscope.operators import state as T
from folioscope.sources.state_store import FILE_STATE, StateTable
from folioscope.staging import staging_root
from workload.fixtures import ORACLE_VIEWS, VIEWS, render_spark
from workload.registry import query

NOW = "TIMESTAMP '2024-01-03 00:00:00'"

# Both snapshots hold every document; another name on one side makes it deleted here and new there.
VIEWS["snapshot_prev"] = """
SELECT CASE WHEN doc_id % 10 = 3 THEN 'old_' ELSE 'doc_' END || CAST(doc_id AS STRING) || '.md' AS path, n_chars AS size,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mtime, md5(text) AS hash,
  TIMESTAMP '2024-01-02 00:00:00' AS last_build
FROM documents
"""
VIEWS["snapshot_cur"] = """
SELECT CASE WHEN doc_id % 10 = 7 THEN 'new_' ELSE 'doc_' END || CAST(doc_id AS STRING) || '.md' AS path,
  n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS size,
  TIMESTAMP '2024-01-01 00:00:00' + (doc_id + CASE WHEN doc_id % 21 = 0 THEN 5 ELSE 0 END) * INTERVAL '1' MINUTE AS mtime,
  md5(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS hash
FROM documents
"""
VIEWS["file_deps"] = """
SELECT 'doc_' || CAST(doc_id AS STRING) || '.md' AS path, 'doc_' || CAST(doc_id - 1 AS STRING) || '.md' AS dep
FROM documents WHERE doc_id % 4 <> 0
UNION ALL
SELECT 'doc_' || CAST(doc_id AS STRING) || '.md', 'doc_0.md' FROM documents WHERE doc_id % 3 = 0 AND doc_id > 0
"""
VIEWS["file_outputs"] = """
SELECT 'doc_' || CAST(doc_id AS STRING) || '.md' AS source, 'out/doc_' || CAST(doc_id AS STRING) || '.html' AS output FROM documents
UNION ALL
SELECT 'doc_' || CAST(doc_id AS STRING) || '.md', 'out/group_' || CAST(doc_id % 100 AS STRING) || '.html' FROM documents
"""
VIEWS["backups"] = """
SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS STRING) AS dir,
  'b' || CAST(o_orderkey AS STRING) AS path, o_orderdate AS mtime FROM orders
"""
VIEWS["changed_paths"] = """
SELECT CASE doc_id % 8 WHEN 0 THEN 'src/mod_' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN '/work/p/pkg/m' || CAST(doc_id AS STRING) || '.py'
  WHEN 2 THEN '/elsewhere/m' || CAST(doc_id AS STRING) || '.py' WHEN 3 THEN 'tests/test_' || CAST(doc_id AS STRING) || '.py'
  WHEN 4 THEN 'docs/d' || CAST(doc_id AS STRING) || '.md' WHEN 5 THEN 'd' || CAST(doc_id AS STRING) || '.rst'
  WHEN 6 THEN CASE WHEN doc_id % 16 = 6 THEN 'pyproject.toml' ELSE '.mcp-docs.yml' END ELSE 'img' || CAST(doc_id AS STRING) || '.png' END AS path
FROM documents
"""
VIEWS["existing_notes"] = """
SELECT CASE WHEN doc_id % 10 = 3 THEN 'own_' ELSE 'doc_' END || CAST(doc_id AS STRING) || '.md' AS path,
  text || CASE doc_id % 7 WHEN 0 THEN '<!-- manual edit -->' WHEN 1 THEN '<!-- added by user -->' WHEN 2 THEN '**Note:** x' WHEN 3 THEN '**Important:**' ELSE '' END AS content
FROM documents
"""
ORACLE_VIEWS["snapshot_diff"] = """
SELECT coalesce(c.path, p.path) AS path,
  CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted'
    WHEN c.size <> p.size OR c.mtime <> p.mtime OR c.hash <> p.hash THEN 'modified' ELSE 'unchanged' END AS change
FROM snapshot_cur c FULL OUTER JOIN snapshot_prev p ON p.path = c.path
"""
ORACLE_VIEWS["rebuild_paths"] = """
SELECT path FROM snapshot_diff WHERE change <> 'unchanged'
UNION SELECT path FROM file_deps WHERE dep IN (SELECT path FROM snapshot_diff WHERE change <> 'unchanged')
"""
ORACLE_VIEWS["categorised"] = """
SELECT * FROM (SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path IN ('.mcp-docs.yaml', '.mcp-docs.yml', 'pyproject.toml') THEN 'config'
  WHEN path LIKE '%.md' OR path LIKE '%.rst' THEN 'documentation' END AS category
FROM (SELECT replace(path, '/work/p/', '') AS path FROM changed_paths WHERE NOT starts_with(path, '/') OR starts_with(path, '/work/p/')))
WHERE category IS NOT NULL AND (category <> 'python' OR NOT contains(path, 'test'))
"""


def _tables(spark, sf, *names):
    return [render_spark(spark, sf, n) for n in names]


def _changed(spark, sf):
    cur, prev = _tables(spark, sf, "snapshot_cur", "snapshot_prev")
    return T.changed_files(T.diff_snapshots(cur, prev))


@query("snapshot_diff", "SELECT path, change FROM snapshot_diff")
def snapshot_diff(spark, sf):
    return T.diff_snapshots(*_tables(spark, sf, "snapshot_cur", "snapshot_prev"))


@query("changed_files", "SELECT path, change FROM snapshot_diff WHERE change <> 'unchanged'")
def changed_files(spark, sf):
    return _changed(spark, sf)


@query(
    "dependent_files",
    "SELECT DISTINCT path FROM file_deps WHERE dep IN (SELECT path FROM snapshot_diff WHERE change <> 'unchanged')",
)
def dependent_files(spark, sf):
    return T.dependents(_changed(spark, sf), render_spark(spark, sf, "file_deps"))


@query("rebuild_set", "SELECT path FROM rebuild_paths")
def rebuild_set(spark, sf):
    return T.rebuild_set(_changed(spark, sf), render_spark(spark, sf, "file_deps"))


@query("skipped_files", "SELECT path FROM snapshot_cur WHERE path NOT IN (SELECT path FROM rebuild_paths)")
def skipped_files(spark, sf):
    rebuild = T.rebuild_set(_changed(spark, sf), render_spark(spark, sf, "file_deps"))
    return T.skipped_files(render_spark(spark, sf, "snapshot_cur"), rebuild)


@query(
    "outdated_outputs",
    "SELECT DISTINCT output FROM file_outputs WHERE source IN (SELECT path FROM snapshot_diff WHERE change <> 'unchanged')",
)
def outdated_outputs(spark, sf):
    return T.outdated_outputs(_changed(spark, sf), render_spark(spark, sf, "file_outputs"))


@query(
    "orphaned_outputs",
    "SELECT source, output FROM file_outputs WHERE source NOT IN (SELECT path FROM snapshot_cur)",
)
def orphaned_outputs(spark, sf):
    return T.orphaned_outputs(*_tables(spark, sf, "snapshot_cur", "file_outputs"))


UPSERT = f"""
SELECT path, size, mtime, hash, last_build FROM snapshot_prev WHERE path NOT IN (SELECT path FROM rebuild_paths)
UNION ALL SELECT path, size, mtime, hash, {NOW} FROM snapshot_cur WHERE path IN (SELECT path FROM rebuild_paths)
"""


def _upserted(spark, sf):
    cur, prev, deps = _tables(spark, sf, "snapshot_cur", "snapshot_prev", "file_deps")
    return T.upsert_state(prev, T.rebuild_set(_changed(spark, sf), deps), cur, F.expr(NOW))


@query("state_upsert", f"SELECT path, size, hash, strftime(last_build, '%Y%m%d') AS built FROM ({UPSERT})")
def state_upsert(spark, sf):
    return _upserted(spark, sf).select(
        "path", "size", "hash", F.date_format("last_build", "yyyyMMdd").alias("built")
    )


@query("state_saved_and_loaded", f"SELECT path, size, hash FROM ({UPSERT})")
def state_saved_and_loaded(spark, sf):
    root = f"{staging_root(spark)}/folioscope/state-{uuid.uuid4().hex}"
    table = StateTable(spark, root, "file_state", FILE_STATE)
    table.save(table.load())
    table.save(_upserted(spark, sf))
    return table.load().select("path", "size", "hash")


@query(
    "output_mapping_replaced",
    """
SELECT source, output FROM file_outputs WHERE source NOT IN (SELECT path FROM snapshot_diff WHERE change = 'modified')
UNION ALL SELECT path, 'new/' || path FROM snapshot_diff WHERE change = 'modified'
""",
)
def output_mapping_replaced(spark, sf):
    update = (
        _changed(spark, sf)
        .where("change = 'modified'")
        .select(F.col("path").alias("source"), F.concat(F.lit("new/"), "path").alias("output"))
    )
    return T.replace_edges(render_spark(spark, sf, "file_outputs"), update, "source")


@query(
    "cache_misses",
    f"""
SELECT c.path FROM snapshot_cur c WHERE NOT EXISTS (
  SELECT 1 FROM snapshot_prev p WHERE p.path = c.path AND p.size = c.size AND p.hash = c.hash AND p.mtime > {NOW} - INTERVAL 170000 SECOND)
""",
)
def cache_misses(spark, sf):
    cur, prev = _tables(spark, sf, "snapshot_cur", "snapshot_prev")
    cache = prev.withColumn("cached_at", F.col("mtime"))
    return T.cache_misses(cur, cache, F.expr(NOW), 170_000).select("path")


@query(
    "live_cache_rows",
    f"SELECT path FROM snapshot_prev WHERE mtime > {NOW} - INTERVAL 170000 SECOND",
)
def live_cache_rows(spark, sf):
    cache = render_spark(spark, sf, "snapshot_prev").withColumn("cached_at", F.col("mtime"))
    return T.live_cache(cache, F.expr(NOW), 170_000).select("path")


@query(
    "hash_verification",
    "SELECT p.path, coalesce(lower(c.hash) = lower(upper(p.hash)), false) AS intact FROM snapshot_prev p LEFT JOIN snapshot_cur c ON c.path = p.path",
)
def hash_verification(spark, sf):
    cur, prev = _tables(spark, sf, "snapshot_cur", "snapshot_prev")
    return T.verify_hashes(cur, prev.select("path", F.upper("hash").alias("expected")))


@query(
    "content_hashes",
    "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
)
def content_hashes(spark, sf):
    docs = render_spark(spark, sf, "documents")
    return docs.select(
        "doc_id", *[T.content_hash(F.col("text"), a).alias(a) for a in ("sha256", "sha1", "md5")]
    )


@query(
    "note_conflicts",
    """
SELECT g.path, 'write' AS action, coalesce(e.edited, false) AS conflict_resolved,
  CASE WHEN e.edited THEN 'backup_and_overwrite' END AS resolution_method,
  CASE WHEN e.edited THEN 'Manual modifications detected, preserved via backup' END AS reason
FROM (SELECT path FROM snapshot_cur) g LEFT JOIN (
  SELECT path, contains(content, '<!-- manual edit -->') OR contains(content, '<!-- added by user -->') OR contains(content, '**Note:**') OR contains(content, '**Important:**') AS edited
  FROM existing_notes) e ON e.path = g.path
""",
)
def note_conflicts(spark, sf):
    generated = render_spark(spark, sf, "snapshot_cur").select("path")
    return T.resolve_conflicts(generated, render_spark(spark, sf, "existing_notes"))


@query("change_categories", "SELECT path, category FROM categorised")
def change_categories(spark, sf):
    return T.categorise_changes(render_spark(spark, sf, "changed_paths"), "/work/p")


@query(
    "change_summary",
    """
SELECT c.category, count(x.category) AS files, '- ' || c.label || ': ' || CAST(count(x.category) AS VARCHAR) AS line
FROM (VALUES ('python', 'Python files'), ('config', 'Config files'), ('documentation', 'Documentation files')) c(category, label)
LEFT JOIN categorised x ON x.category = c.category GROUP BY c.category, c.label
""",
)
def change_summary(spark, sf):
    return T.change_summary(T.categorise_changes(render_spark(spark, sf, "changed_paths"), "/work/p"))


@query(
    "config_warnings",
    """
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, m AS message FROM (
  SELECT 0 AS o, 'Configuration changed - full regeneration recommended for complete consistency' AS m WHERE EXISTS (SELECT 1 FROM categorised WHERE path IN ('.mcp-docs.yaml', '.mcp-docs.yml'))
  UNION ALL SELECT 1, 'Project metadata changed - consider updating documentation metadata' WHERE EXISTS (SELECT 1 FROM categorised WHERE path = 'pyproject.toml'))
""",
)
def config_warnings(spark, sf):
    return T.config_warnings(T.categorise_changes(render_spark(spark, sf, "changed_paths"), "/work/p"))


@query(
    "changes_since",
    "SELECT path, strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS last_modified, 'modified' AS change_type FROM snapshot_cur WHERE mtime > TIMESTAMP '2024-01-01 01:30:00'",
)
def changes_since(spark, sf):
    files = render_spark(spark, sf, "snapshot_cur")
    return T.changes_since(files, "2024-01-01T01:30:00Z").select(
        "path",
        F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
        F.lit("modified").alias("change_type"),
    )


@query(
    "build_stats",
    f"""
SELECT (SELECT count(*) FROM snapshot_prev) AS tracked_files, (SELECT count(DISTINCT path) FROM file_deps) AS dependency_mappings,
  (SELECT count(DISTINCT source) FROM file_outputs) AS output_mappings,
  epoch({NOW} - (SELECT max(last_build) FROM snapshot_prev)) / 3600 AS hours_since_full_build,
  epoch({NOW} - (SELECT max(last_build) FROM snapshot_prev)) / 3600 > 24 AS full_build_due
""",
)
def build_stats(spark, sf):
    prev, deps, outputs = _tables(spark, sf, "snapshot_prev", "file_deps", "file_outputs")
    meta = prev.select(F.col("last_build").alias("last_full_build"))
    return T.build_stats(prev, deps, outputs, meta, F.expr(NOW))


@query(
    "incremental_run_statistics",
    """
SELECT (SELECT count(*) FROM snapshot_cur) AS files_checked, (SELECT count(*) FROM snapshot_diff WHERE change <> 'unchanged') AS files_changed,
  (SELECT count(*) FROM rebuild_paths) AS files_to_rebuild,
  (SELECT count(*) FROM snapshot_cur WHERE path NOT IN (SELECT path FROM rebuild_paths)) AS files_skipped
""",
)
def incremental_run_statistics(spark, sf):
    cur, prev, deps = _tables(spark, sf, "snapshot_cur", "snapshot_prev", "file_deps")
    diff = T.diff_snapshots(cur, prev)
    return T.run_statistics(cur, diff, T.rebuild_set(T.changed_files(diff), deps))


@query(
    "expired_backups",
    """
SELECT dir, path FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY mtime DESC, path) AS r FROM backups)
WHERE r > 5 AND mtime < TIMESTAMP '1998-12-01 00:00:00' - INTERVAL 365 DAY
""",
)
def expired_backups(spark, sf):
    backups = render_spark(spark, sf, "backups")
    return T.expired_backups(backups, F.expr("TIMESTAMP '1998-12-01 00:00:00'"), 365, 5).select("dir", "path")


@query(
    "sanitised_filenames",
    r"""
SELECT doc_id, CASE WHEN length(n) > 250 THEN n[1:250] ELSE n END AS name FROM (
  SELECT doc_id, CASE WHEN t = '' THEN 'unnamed_file' ELSE t END AS n FROM (
    SELECT doc_id, regexp_replace(translate(head, '<>:"/\|?*', '_________'), '^[. \t\n\r]+|[. \t\n\r]+$', '', 'g') AS t
    FROM (SELECT doc_id, replace(replace(text, '.', ':'), chr(10), '?') AS head FROM documents)))
""",
)
def sanitised_filenames(spark, sf):
    docs = render_spark(spark, sf, "documents")
    raw = F.replace(F.replace("text", F.lit("."), F.lit(":")), F.lit("\n"), F.lit("?"))
    return docs.select("doc_id", paths.sanitise_filename(raw).alias("name"))
