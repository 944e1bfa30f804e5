"""Telemetry as streams: periodic metric rows, and running throughput per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.telemetry import every


def emit_metrics(steps: DataFrame, out: str, checkpoint: str, interval: int = 1, **trigger) -> StreamingQuery:
    """Append every ``interval``-th step to a table kept by run; a restart repeats nothing."""
    writer = every(steps, interval).writeStream.outputMode("append").format("parquet")
    writer = writer.partitionBy("run").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_throughput(rows: DataFrame) -> DataFrame:
    """Tokens per second since (re)start from ``(run, restart, at, tokens)``, batch or streaming.

    The state per run is three numbers, and they combine map-side, so a run with a third of all rows
    sends one small row per task.
    """
    totals = rows.groupBy("run", "restart").agg(
        F.sum("tokens").alias("tokens"), F.min("at").alias("started"), F.max("at").alias("last")
    )
    seconds = (F.col("last") - F.col("started")) / F.lit(1_000_000.0)
    return totals.select(
        "run", "restart", "tokens", seconds.alias("seconds"), (F.col("tokens") / F.greatest(seconds, F.lit(1e-6))).alias("tokens_per_second")
    )


def latest_throughput(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``out`` at the newest totals: each batch writes the runs it changed under its own id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = running_throughput(rows).writeStream.outputMode("update").foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_throughput(spark, out: str) -> DataFrame:
    """The last row written for each run."""
    rows = spark.read.option("basePath", out).parquet(out)
    fields = [c for c in rows.columns if c not in ("run", "restart", "batch")]
    newest = F.max_by(F.struct(*fields), "batch").alias("_row")
    return rows.groupBy("run", "restart").agg(newest).select("run", "restart", "_row.*")
