"""Joins and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.staging import stage

# A key is heavy when it has more rows than one task should read.
TASK_ROWS = 1_000_000
# Heavy keys that are named, at most: the heaviest. All others have fewer rows than these.
HEAVY_KEYS = 100_000


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "left",
    heavy_rows: int = TASK_ROWS,
    staged: bool = False,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which holds one row per key, without a hot task.

    The facts are narrow by the time they get here; they are written once (unless already
    ``staged``), so that counting their keys does not compute them twice. Rows without a key
    match nothing and pass by the join. Rows of a key with more than ``heavy_rows`` rows are
    dealt to one salt for each so many rows, and only that key's lookup row is repeated as
    often. The list of heavy keys is bounded by ``HEAVY_KEYS`` and so may be broadcast.
    """
    if not staged:
        facts = stage(facts, "facts")
    heavy = (
        facts.where(F.col(on).isNotNull())
        .groupBy(F.col(on).alias("_hot"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > heavy_rows)
        .orderBy(F.desc("_rows"))
        .limit(HEAVY_KEYS)
    )
    found = heavy.collect()
    named = facts.where(F.col(on).isNotNull())
    if not found:
        joined = named.join(lookup, on, how)
    else:
        hot = facts.sparkSession.createDataFrame(found, heavy.schema).select(
            "_hot", F.ceil(F.col("_rows") / heavy_rows).cast("int").alias("_salts")
        )
        hot = F.broadcast(hot)
        salted = named.withColumn("_turn", F.monotonically_increasing_id()).join(
            hot, F.col(on) == F.col("_hot"), "left"
        )
        turn = F.pmod(F.col("_turn"), F.col("_salts")).cast("int")
        salted = salted.select(*facts.columns, F.coalesce(turn, F.lit(0)).alias("_salt"))
        copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        repeated = lookup.join(hot, F.col(on) == F.col("_hot"), "left").select(
            *lookup.columns, F.explode(copies).alias("_salt")
        )
        joined = salted.join(repeated, [on, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(facts.where(F.col(on).isNull()), allowMissingColumns=True)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row frames with disjoint columns side by side, without a cross join."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def number_rows(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number all rows from 0 in a total order given by unique ``order`` columns.

    A window without partitions would put every row into one task. Here the rows are range
    partitioned and staged, and only the per-partition counts meet in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered"
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_part", "_offset")
    )


def batches(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Cut an ordered list into batches of ``size`` rows."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return number_rows(df, order).withColumn(
        "batch", F.floor(F.col("position") / size).cast("bigint")
    )
