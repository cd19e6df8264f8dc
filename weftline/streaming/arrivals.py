"""Diffs that arrive as a stream: every change set is planned by itself, so each micro-batch is a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.strategies import Plan, by_file
from ..sources.diff import parse_diff


def diff_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of (changeset_id, diff_text) as they come."""
    return spark.readStream.schema("changeset_id long, diff_text string").parquet(folder)


def plan_arrivals(diffs: DataFrame, out: str, checkpoint: str, plan: Callable[[DataFrame | None, DataFrame], Plan] = by_file, **trigger) -> StreamingQuery:
    """Plan the change sets of each micro-batch; a batch that is run again after a failure replaces its own files only."""

    def run(batch: DataFrame, number: int) -> None:
        found = plan(None, parse_diff(batch).hunks)
        found.commits.write.mode("overwrite").parquet(f"{out}/commits/batch={number}")
        found.changes.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    return diffs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
