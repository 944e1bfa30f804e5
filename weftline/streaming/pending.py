"""Picking up finished work as it appears, and keeping the list of what remains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.pending import finished, missing, remaining, runnable


def stream_finished(reports: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Collect streamed ``(key…, task)`` reports, one folder per batch id, replays overwriting it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = reports.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def collected(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out).drop("batch")


def remaining_plan(
    plan: DataFrame, reports: DataFrame, available: DataFrame, key: str, tasks: Sequence[str]
) -> DataFrame:
    """What is left of the plan, and whether its input exists: ``(key, state)``."""
    left = remaining(plan, finished(reports, key, tasks), [key])
    ready = runnable(left, available, [key]).withColumn("state", F.lit("runnable"))
    return ready.unionByName(missing(left, available, [key]).withColumn("state", F.lit("missing")))
