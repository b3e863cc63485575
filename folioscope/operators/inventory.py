"""Symbol inventory of a code corpus: files(path, content STRING) to flat tables.

Extraction runs as one Arrow-batched pass over the cache misses; its narrow output is staged
and everything after it is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioscope.functions import paths, python_source, text
from folioscope.staging import stage

RECORDS = (
    "path string, record string, ord int, name string, parent string, kind string, docstring string, "
    "line_number int, signature string, is_async boolean, is_static boolean, is_class boolean, "
    "is_private boolean, parameters array<string>, parameter_types map<string,string>, "
    "return_type string, decorators array<string>, base_classes array<string>, "
    "variables map<string,string>, constants map<string,string>, import_name string, "
    "imported_names array<string>, error string"
)


def extract(files: DataFrame, rows_per_batch: int = 5000) -> DataFrame:
    """All records of all files, written once.

    Parsing costs far more than moving the text, so files are dealt out evenly first; a few
    large input splits would otherwise leave most cores idle.
    """
    # Executors need no copy of this package: the helper module travels with the task.
    cloudpickle.register_pickle_by_value(python_source)
    schema = to_arrow_schema(StructType.fromDDL(RECORDS))
    maps = ["parameter_types", "variables", "constants"]
    parse = python_source.records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for i, record in enumerate(parse(content.as_py() or "")):
                    pairs = {m: record[m] and list(record[m].items()) for m in maps if record[m] is not None}
                    rows.append(record | {m: p or [] for m, p in pairs.items()} | {"path": path.as_py(), "ord": i})
                if len(rows) >= rows_per_batch:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    slots = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "content").repartition(slots)
    return stage(dealt.mapInArrow(run, RECORDS), "symbol-records")


def modules_of(records: DataFrame, files: DataFrame, project: str) -> DataFrame:
    path = F.col("path")
    sizes = files.select(
        "path",
        F.octet_length("content").alias("size"),
        text.line_count(F.col("content")).alias("line_count"),
    )
    found = records.where("record = 'module'").select(
        "path", "docstring", "constants", "variables"
    )
    return found.join(sizes, "path").select(
        paths.module_name(path, project).alias("name"),
        path.alias("file_path"),
        "docstring",
        paths.is_package(path).alias("is_package"),
        paths.package_path(path).alias("package_path"),
        "constants",
        "variables",
        "size",
        "line_count",
    )


def symbols_of(records: DataFrame, project: str) -> DataFrame:
    return records.where("record = 'symbol'").select(
        paths.module_name(F.col("path"), project).alias("module"),
        "kind", "name", "parent", "docstring", "line_number", "signature", "is_async", "is_static",
        "is_class", "is_private", "parameters", "parameter_types", "return_type", "decorators",
        "base_classes", "variables",
    )


def imports_of(records: DataFrame, project: str) -> DataFrame:
    return records.where("record = 'import'").select(
        paths.module_name(F.col("path"), project).alias("module"), "ord", "import_name", "imported_names"
    )


def from_imports(imports: DataFrame) -> DataFrame:
    """Names imported from each module, repeated statements united."""
    return (
        imports.where(F.col("imported_names").isNotNull())
        .select("module", "import_name", F.explode("imported_names").alias("imported"))
        .distinct()
    )


def parse_errors(records: DataFrame) -> DataFrame:
    return records.where("record = 'error'").select("path", "error")
