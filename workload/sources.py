"""Queries that scan files, which Spark first writes from the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.sources import files
from folioscope.staging import staging_root
from workload.fixtures import VIEWS, render_spark
from workload.registry import query

# Every document as a file: sources, notes and pages in nested folders, some of them hidden.
VIEWS["project_files"] = """
SELECT 'part_' || CAST(doc_id % 7 AS STRING) || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE '' END
  || CASE WHEN doc_id % 9 = 0 THEN '.' WHEN doc_id % 9 = 1 THEN '_' ELSE '' END || 'doc_' || CAST(doc_id AS STRING)
  || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.html' END AS path,
  CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS content
FROM documents
"""
READ = "regexp_replace(content, '\\r\\n?', chr(10), 'g')"


def _written(spark, sf):
    root = f"{staging_root(spark)}/folioscope/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"
    return files.write_files(render_spark(spark, sf, "project_files"), root)


@query(
    "scanned_sources",
    "SELECT path, strlen(content) AS size FROM project_files WHERE path LIKE '%.py' AND NOT contains(path, 'tests/')",
)
def scanned_sources(spark, sf):
    """Python files with their size, excluded folders left out."""
    return files.scan_sources(spark, _written(spark, sf), ["*/tests/*"]).select("path", "size")


@query("scanned_notes", f"SELECT path, {READ} AS content FROM project_files WHERE path LIKE '%.md'")
def scanned_notes(spark, sf):
    """Markdown files with content, hidden ones too."""
    return files.scan_notes(spark, _written(spark, sf)).select("path", "content")


@query("scanned_pages", f"SELECT path AS rel_path, {READ} AS html FROM project_files WHERE path LIKE '%.html'")
def scanned_pages(spark, sf):
    """HTML files as the page conversion reads them."""
    return files.scan_pages(spark, _written(spark, sf)).select("rel_path", "html")


@query(
    "scanned_files",
    "SELECT path, strlen(content) AS size FROM project_files WHERE NOT regexp_matches(path, '(^|/)\\.[^/]*$')",
)
def scanned_files(spark, sf):
    """All files that are not hidden, with their size."""
    return files.scan_files(spark, _written(spark, sf)).select("path", F.col("size").cast("long").alias("size"))
