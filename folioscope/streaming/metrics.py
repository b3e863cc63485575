"""Counts of the stages of a job, gathered while it runs, as rows.

Each stage is a named observation inside the plan, so nothing is read twice for its counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BATCH_ROWS = "stage string, metric string, value long"
STREAM_ROWS = "query string, batch long, stage string, metric string, value long"


class StageMetrics:
    """Observes the stages of a batch job. The counts are there once an action has run over them."""

    def __init__(self):
        self._stages: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """Count the rows that pass, and whatever whole-number aggregates are named besides."""
        if stage in self._stages:
            raise ValueError(f"stage {stage} is watched already")
        self._stages[stage] = Observation(stage)
        return df.observe(self._stages[stage], *_measures(more))

    def rows(self, spark: SparkSession) -> DataFrame:
        found = [(s, m, v) for s, seen in self._stages.items() for m, v in seen.get.items()]
        return spark.createDataFrame(found, BATCH_ROWS)


def watch_stream(df: DataFrame, stage: str, **more: Column) -> DataFrame:
    """The same for a stage of a stream, whose counts come with each batch's progress."""
    return df.observe(stage, *_measures(more))


def _measures(more: dict[str, Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(n) for n, c in more.items())]


def progress_rows(progress: Iterable) -> list[tuple]:
    """(query, batch, stage, metric, value) of progress reports: what the source gave, and each stage."""
    out = []
    for p in progress:
        name = p.name or str(p.id)
        out.append((name, p.batchId, "source", "rows", p.numInputRows))
        for stage, seen in p.observedMetrics.items():
            out += [(name, p.batchId, stage, metric, value) for metric, value in seen.asDict().items()]
    return out


class ProgressLog(StreamingQueryListener):
    """Keeps the counts of the last ``limit`` progress reports of all streams of a session."""

    def __init__(self, limit: int = 1000):
        self._reports: list = []
        self._limit = limit

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._reports = [*self._reports, event.progress][-self._limit :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(progress_rows(self._reports), STREAM_ROWS)
