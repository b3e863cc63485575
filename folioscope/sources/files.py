"""File scans over any file system that Arrow can open.

Spark's own file sources skip every name that begins with ``_`` or ``.``, and with it each
package's ``__init__.py``. Folders are therefore listed by tasks, one round per level of depth,
and contents are read by tasks only where a plan asks for them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioscope.functions import paths
from folioscope.staging import stage

# Entries of a folder that make one batch.
LISTED_AT_ONCE = 10_000
LISTING = "path string, is_dir boolean, size long, mtime timestamp"


def _uri(root: str) -> str:
    return root if ":/" in root else Path(root).absolute().as_uri()


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _entries(system, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is_dir, size, mtime in us) of what is in a folder, which may hold any number of files.

    Mounted folders are read entry by entry. Arrow gives the listing of other stores as a whole, so
    there a task holds its largest folder.
    """
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for i in system.get_file_info(fs.FileSelector(folder)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000
        return
    with os.scandir(folder or "/") as entries:
        for entry in entries:
            try:
                is_dir, status = entry.is_dir(), entry.stat()
            except FileNotFoundError:  # a dangling link, or gone since it was listed
                continue
            yield entry.name, is_dir, 0 if is_dir else status.st_size, status.st_mtime_ns // 1000


def scan_files(
    spark: SparkSession, root: str, suffix: str = "", hidden: bool = False
) -> DataFrame:
    """(path, size, mtime) of all files below a folder, without reading any of them.

    Files whose name starts with a dot are left out unless ``hidden``.
    """
    base = _uri(root).rstrip("/")

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                entries = _entries(system, f"{top}/{folder}".rstrip("/"))
                while inside := list(islice(entries, LISTED_AT_ONCE)):
                    names, folders, sizes, times = zip(*inside, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "path": [f"{folder}/{name}".lstrip("/") for name in names],
                            "is_dir": pa.array(folders, pa.bool_()),
                            "size": pa.array(sizes, pa.int64()),
                            "mtime": pa.array(times, pa.timestamp("us", "UTC")),
                        }
                    )

    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        listed = stage(level.repartition(_tasks(spark)).mapInArrow(list_folders, LISTING), "listing")
        here = listed.where("NOT is_dir").drop("is_dir")
        found = here if found is None else found.unionByName(here)
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            break
    kept = found.where(F.col("path").endswith(suffix)) if suffix else found
    return kept if hidden else kept.where(~paths.basename(F.col("path")).startswith("."))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Add ``content``, decoded with line ends as line feeds.

    It is null when the file is not UTF-8 or is gone since it was listed.
    """
    base = _uri(root).rstrip("/")
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for i, path in enumerate(batch["path"].to_pylist()):
                try:
                    with system.open_input_file(f"{top}/{path}") as handle:
                        body = pa.array([handle.readall()], pa.binary())
                except FileNotFoundError:
                    body = pa.array([None], pa.binary())
                yield batch.slice(i, 1).append_column("content", body)

    spread = files.repartition(_tasks(files.sparkSession))
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    return spread.mapInArrow(read, schema).withColumn(
        "content", F.regexp_replace(decoded, r"\r\n?", "\n")
    )


def write_files(files: DataFrame, root: str) -> str:
    """Write (path, content) rows as files below a folder that all executors share.

    A task that is run again writes the same files again. A null content makes an empty file.
    """
    base = _uri(root).rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = f"{top}/{path.as_py()}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((content.as_py() or "").encode())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    return root


def scan_sources(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """Python files, the excluded ones dropped by path before any content is read."""
    found = scan_files(spark, root, ".py", hidden=True)
    return found.where(~paths.excluded(F.col("path"), list(exclude), "glob"))


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes with content."""
    return with_content(scan_files(spark, root, ".md", hidden=True), root)


def scan_pages(spark: SparkSession, root: str) -> DataFrame:
    """HTML pages as the page conversion expects them."""
    found = with_content(scan_files(spark, root, ".html", hidden=True), root)
    return found.select(F.col("path").alias("rel_path"), F.col("content").alias("html"), "mtime")


def snapshot(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(path, size, mtime, hash) of files with content."""
    from folioscope.operators.state import content_hash

    return files.select("path", "size", "mtime", content_hash(F.col("content"), algorithm).alias("hash"))


def reading_order(files: DataFrame) -> DataFrame:
    """Files by path segments, the order in which the first of several owners is chosen."""
    return files.orderBy(F.split("path", "/"))
