"""Snapshot comparison, incremental rebuild planning and build state.

Snapshots and states are tables (path, size, mtime, hash[, last_build]); path is unique, so
these joins have no hot keys. Edge tables file_deps(path, dep) and file_outputs(source, output)
may repeat one file any number of times.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import paths, text
from folioscope.operators.joins import lookup_join, one_row

# Configuration files and documentation suffixes of the change categories,
# marks of hand-edited notes.
CONFIG_FILES = [".mcp-docs.yaml", ".mcp-docs.yml", "pyproject.toml"]
DOC_SUFFIXES = [".md", ".rst"]
MANUAL_MARKS = ["<!-- manual edit -->", "<!-- added by user -->", "**Note:**", "**Important:**"]
HASHES = ["sha256", "sha512", "sha384", "sha224", "sha1", "md5"]


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a content column; an unknown algorithm fails before the job starts."""
    if algorithm not in HASHES:
        raise ValueError(f"unknown hash algorithm {algorithm}")
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    return F.sha2(content, int(algorithm[3:]))


def diff_snapshots(current: DataFrame, state: DataFrame) -> DataFrame:
    """Change per path: new, modified, deleted or unchanged.

    Modified means a different size, time or hash, so a touched file counts.
    """
    measures = ["size", "mtime", "hash"]
    left = current.select("path", F.struct(*measures).alias("now"))
    right = state.select("path", F.struct(*measures).alias("before"))
    return left.join(right, "path", "full_outer").select(
        "path",
        F.when(F.col("before").isNull(), "new")
        .when(F.col("now").isNull(), "deleted")
        .when(F.col("now").eqNullSafe(F.col("before")), "unchanged")
        .otherwise("modified")
        .alias("change"),
    )


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("change") != "unchanged")


def dependents(changed: DataFrame, file_deps: DataFrame) -> DataFrame:
    """Files that depend directly on a changed file; a third of all may depend on one."""
    keys = changed.select(F.col("path").alias("dep"))
    return lookup_join(file_deps.select("path", "dep"), keys, "dep", "inner").select("path").distinct()


def rebuild_set(changed: DataFrame, file_deps: DataFrame) -> DataFrame:
    """Changed files and their dependents."""
    return changed.select("path").union(dependents(changed, file_deps)).distinct()


def skipped_files(current: DataFrame, rebuild: DataFrame) -> DataFrame:
    return current.select("path").join(rebuild.select("path"), "path", "left_anti")


def outdated_outputs(changed: DataFrame, file_outputs: DataFrame) -> DataFrame:
    keys = changed.select(F.col("path").alias("source"))
    return file_outputs.join(keys, "source", "left_semi").select("output").distinct()


def orphaned_outputs(current: DataFrame, file_outputs: DataFrame) -> DataFrame:
    """Outputs whose source is gone; reported, never deleted."""
    keys = current.select(F.col("path").alias("source"))
    return file_outputs.join(keys, "source", "left_anti").select("source", "output")


def upsert_state(
    state: DataFrame, built: DataFrame, current: DataFrame, now: Column
) -> DataFrame:
    """State after building the files ``built(path)``; built files that vanished are dropped."""
    fresh = current.join(built.select("path"), "path", "left_semi").select(
        "path", "size", "mtime", "hash", now.alias("last_build")
    )
    kept = state.join(built.select("path"), "path", "left_anti")
    return kept.select("path", "size", "mtime", "hash", "last_build").unionByName(fresh)


def replace_edges(edges: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Replace all edges of every key that occurs in the update."""
    keys = update.select(key).distinct()
    return edges.join(keys, key, "left_anti").unionByName(update)


def cache_misses(files: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Files that must be extracted again: no fresh cache row of the same size and hash."""
    fresh = live_cache(cache, now, ttl_seconds).select("path", "size", "hash")
    return files.join(fresh, ["path", "size", "hash"], "left_anti")


def live_cache(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return cache.where(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def verify_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare hashes, ignoring case; a missing file does not match."""
    return expected.join(files.select("path", F.col("hash").alias("actual")), "path", "left").select(
        "path",
        F.coalesce(F.lower("actual") == F.lower("expected"), F.lit(False)).alias("intact"),
    )


def manually_edited(content: Column) -> Column:
    return text.has_any(content, MANUAL_MARKS)


def resolve_conflicts(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Every generated note is written; a hand-edited predecessor is backed up."""
    edited = existing.select("path", manually_edited(F.col("content")).alias("edited"))
    conflict = F.coalesce("edited", F.lit(False))
    return generated.join(edited, "path", "left").select(
        "path",
        F.lit("write").alias("action"),
        conflict.alias("conflict_resolved"),
        F.when(conflict, "backup_and_overwrite").alias("resolution_method"),
        F.when(conflict, "Manual modifications detected, preserved via backup").alias("reason"),
    )


def change_category(path: Column) -> Column:
    """python, config, documentation or null."""
    return (
        F.when(paths.suffix(path) == ".py", "python")
        .when(paths.basename(path).isin(CONFIG_FILES), "config")
        .when(paths.suffix(path).isin(DOC_SUFFIXES), "documentation")
    )


def categorise_changes(changed: DataFrame, project: str = "", exclude: list[str] = ()) -> DataFrame:
    """Categories of changed paths.

    Absolute paths are made relative to the project; those outside are dropped. Python files
    outside the update scope are dropped too.
    """
    p = F.col("path")
    absolute = p.startswith("/")
    root = project.rstrip("/") + "/"
    inside = changed.where(~absolute | p.startswith(root)).withColumn(
        "path", F.when(absolute, F.substring(p, F.lit(len(root) + 1), F.length(p))).otherwise(p)
    )
    in_scope = ~paths.excluded(p, list(exclude), "substring_or_path") & ~F.lower(p).contains("test")
    return (
        inside.withColumn("category", change_category(p))
        .where(F.col("category").isNotNull())
        .where((F.col("category") != "python") | in_scope)
    )


def config_warnings(changes: DataFrame) -> DataFrame:
    from folioscope.functions import rules

    seen = changes.agg(
        F.coalesce(F.bool_or(F.col("path").isin(CONFIG_FILES[:2])), F.lit(False)).alias("settings"),
        F.coalesce(F.bool_or(F.col("path") == CONFIG_FILES[2]), F.lit(False)).alias("project"),
    )
    return rules.as_rows(
        seen,
        rules.messages(
            (
                F.col("settings"),
                F.lit("Configuration changed - full regeneration recommended for complete consistency"),
            ),
            (
                F.col("project"),
                F.lit("Project metadata changed - consider updating documentation metadata"),
            ),
        ),
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Number of changed files per category, zeros included, with a line of text each."""
    labels = {"python": "Python files", "config": "Config files", "documentation": "Documentation files"}
    one = changes.agg(*[F.count_if(F.col("category") == c).alias(c) for c in labels])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.col(c).alias("files"),
                F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")).alias("line"),
            )
            for c, label in labels.items()
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def parsed_time(since: str) -> datetime | None:
    """An ISO time stamp given as a job parameter, None if it is none; ``Z`` is accepted."""
    try:
        return datetime.fromisoformat(since.replace("Z", "+00:00"))
    except ValueError:
        return None


def is_timestamp(since: str) -> bool:
    """Whether a job parameter is an ISO time stamp."""
    return parsed_time(since) is not None


def changes_since(files: DataFrame, since: str | None) -> DataFrame:
    """Files modified after an ISO time stamp; without one, every file.

    A time stamp that cannot be read gives no file; see ``is_timestamp``. One without a zone is
    in that of the session.
    """
    if since is None:
        return files
    at = parsed_time(since)
    if at is None:
        return files.where(F.lit(False))
    # Text that Spark reads in the session's zone, whatever form the parameter had.
    return files.where(F.col("mtime") > F.lit(at.isoformat(" ")).cast("timestamp"))


def build_stats(
    state: DataFrame, file_deps: DataFrame, file_outputs: DataFrame, meta: DataFrame, now: Column,
    force_after_hours: float = 24.0,
) -> DataFrame:
    """Counts of the build state and whether a full build is due; ``meta(last_full_build)``."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_full_build").cast("timestamp"))) / 3.6e9
    counts = one_row(
        state.agg(F.count(F.lit(1)).alias("tracked_files")),
        file_deps.agg(F.count_distinct("path").alias("dependency_mappings")),
        file_outputs.agg(F.count_distinct("source").alias("output_mappings")),
        meta.agg(F.max("last_full_build").alias("last_full_build")),
    )
    return counts.select(
        "tracked_files",
        "dependency_mappings",
        "output_mappings",
        hours.alias("hours_since_full_build"),
        F.coalesce(hours > force_after_hours, F.lit(True)).alias("full_build_due"),
    )


def run_statistics(
    current: DataFrame, diff: DataFrame, rebuild: DataFrame
) -> DataFrame:
    return one_row(
        current.agg(F.count(F.lit(1)).alias("files_checked")),
        changed_files(diff).agg(F.count(F.lit(1)).alias("files_changed")),
        rebuild.agg(F.count(F.lit(1)).alias("files_to_rebuild")),
        skipped_files(current, rebuild).agg(F.count(F.lit(1)).alias("files_skipped")),
    )


def expired_backups(
    backups: DataFrame, now: Column, max_age_days: int = 30, keep_count: int = 5
) -> DataFrame:
    """Backups(dir, path, mtime) to expire: old ones beyond the newest ``keep_count``.

    The kept ones are found with a per-folder top-k that is cut before the shuffle, and the
    rest is an anti-join on the unique path, so a folder with a third of all backups is spread.
    """
    newest = Window.partitionBy("dir").orderBy(F.desc("mtime"), "path")
    kept = (
        backups.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= keep_count)
        .select("dir", "path")
    )
    old = backups.where(F.col("mtime") < now - F.make_dt_interval(F.lit(max_age_days)))
    return old.join(kept, ["dir", "path"], "left_anti")
