"""Versioned state tables.

A state is never overwritten while it is read: each save writes a new version folder, and a
version counts once its marker row has been appended to the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

FILE_STATE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("hash", T.StringType()),
        T.StructField("last_build", T.TimestampType()),
    ]
)
FILE_DEPS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("dep", T.StringType())]
)
FILE_OUTPUTS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("output", T.StringType())]
)
BUILD_META = T.StructType([T.StructField("last_full_build", T.TimestampType())])
SYMBOL_CACHE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("cached_at", T.TimestampType()),
    ]
)
_LOG = T.StructType([T.StructField("version", T.LongType())])


class StateTable:
    """One named state under a root folder."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.base = f"{root.rstrip('/')}/{name}"

    def _version(self) -> int | None:
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.base}/log")
        except AnalysisException:
            return None
        return log.agg(F.max("version")).first()[0]

    def load(self) -> DataFrame:
        """The latest version, or an empty table when nothing was saved yet."""
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/v{version}")

    def save(self, rows: DataFrame) -> DataFrame:
        """Write the next version, then make it the latest; safe to repeat after a failure."""
        version = (self._version() or 0) + 1
        target = f"{self.base}/v{version}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.mode("overwrite").parquet(target)
        marker = self.spark.range(version, version + 1).select(F.col("id").alias("version"))
        marker.write.mode("append").parquet(f"{self.base}/log")
        return self.spark.read.schema(self.schema).parquet(target)


def load_cache(spark: SparkSession, root: str, now, ttl_seconds: int) -> DataFrame:
    """Symbol cache without expired rows."""
    from folioscope.operators.state import live_cache

    return live_cache(StateTable(spark, root, "symbol_cache", SYMBOL_CACHE).load(), now, ttl_seconds)
