"""Writers: notes by folder, reports as JSON, ordered text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.staging import staging_root


def write_notes(notes: DataFrame, path: str | None = None, name: str = "notes") -> DataFrame:
    """Write notes in order of their folders and return the table.

    Rebalancing brings a folder's rows together, splits a folder with a third of all notes
    over several tasks by size, and merges small ones. The folder stays a column, by whose
    bounds files are skipped: a directory for each of millions of folders would be one tiny
    file each.
    """
    spark = notes.sparkSession
    target = path or f"{staging_root(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    notes.hint("rebalance", F.col("folder")).sortWithinPartitions("folder").write.mode("overwrite").parquet(target)
    return spark.read.schema(notes.schema).parquet(target)


def write_report(report: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write a text column ``line`` in a global order, as part files that follow each other."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
