"""Intermediate tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders of local sessions without the setting, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="folioscope-")
    return _LOCAL_ROOTS[context.applicationId]


def _home(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/folioscope/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete everything this application has staged. Call it once results are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_home(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.delete(folder, True)


class Stage:
    """Writes successive versions of a table, keeping only the last two.

    A loop reads version k while it writes version k + 1, so two folders used in turn are
    enough and the space does not grow with the number of rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
        self._version = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self._base}/slot{self._version % 2}"
        self._version += 1
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    return Stage(df.sparkSession, name).write(df)
