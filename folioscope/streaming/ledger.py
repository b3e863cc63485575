"""Which callbacks a batch has already reached, kept beside the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Ledger:
    """An empty file for each (batch, callback), made after the callback has returned.

    A stream that ends between a batch and its commit runs that batch again under the same number,
    so only the last batch can come again; entries of earlier ones are dropped as the stream goes on.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._base = f"{checkpoint.rstrip('/')}/ledger"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self._base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, batch_id: int, callback: str):
        return self._path(f"{self._base}/{batch_id}/{callback}")

    def reached(self, batch_id: int, callback: str) -> bool:
        return self._files.exists(self._entry(batch_id, callback))

    def enter(self, batch_id: int, callback: str) -> None:
        self._files.createNewFile(self._entry(batch_id, callback))

    def forget_before(self, batch_id: int) -> None:
        if self._files.exists(self._path(self._base)):
            for entry in self._files.listStatus(self._path(self._base)):
                if int(entry.getPath().getName()) < batch_id:
                    self._files.delete(entry.getPath(), True)
