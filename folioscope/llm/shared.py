"""What the operators share: inputs, fixed folds, bounded labelled samples, model broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of labelled text that a classifier is fitted on, at most.
SAMPLE_ROWS = 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def sample_ids(labels: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows of a narrow table, chosen by a hash of the key: the same every time."""
    return labels.orderBy(F.xxhash64(key), F.col(key)).limit(rows)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, chosen: Column, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents for which ``chosen`` holds.

    The ids are bounded by ``rows``, which is what makes the broadcast safe.
    """
    ids = sample_ids(
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .where(chosen),
        "doc_id",
        rows,
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")
    )
