"""Training telemetry: micro-batch rows to step metrics.

A run may hold a third of all rows, so ordering inside a run goes through the two-level running
total: ranges of the order key, not whole runs, are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.math import perplexity, rate_factor
from weftline.operators.prefix import running_rank, running_total


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, untouched by the session's time zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint")
    return (day * 86_400 + clock) * 1_000_000 + (F.date_part(F.lit("second"), ts) * 1_000_000).cast("bigint")


def micro_steps(losses: DataFrame, **more) -> DataFrame:
    """Add ``micro``: position in the run. ``losses`` holds ``(run, seq, at, loss)``, ``seq`` unique."""
    return running_rank(losses, "seq", "micro", ["run"], **more)


def step_losses(micro: DataFrame, accumulate: int) -> DataFrame:
    """Mean loss of every complete group of ``accumulate`` micro-batches; steps count from 1."""
    grouped = micro.withColumn("step", F.expr(f"micro div {accumulate} + 1")).groupBy("run", "step").agg(
        F.avg("loss").alias("loss"),
        F.max("at").alias("at"),
        F.min("started").alias("started"),
        F.count(F.lit(1)).alias("_n"),
    )
    return grouped.where(F.col("_n") == accumulate).drop("_n")


def step_metrics(losses: DataFrame, accumulate: int, micro_tokens: int, warmup: int, total_steps: int) -> DataFrame:
    """Loss, capped perplexity, learning-rate factor, tokens and cumulative tokens/s per step."""
    steps = step_losses(micro_steps(losses, first={"started": "at"}), accumulate)
    elapsed = (F.col("at") - F.col("started")) / F.lit(1_000_000.0)
    return (
        steps.withColumn("ppl", perplexity(F.col("loss")))
        .withColumn("lr_factor", rate_factor(F.col("step"), warmup, total_steps))
        .withColumn("tokens", F.col("step") * (accumulate * micro_tokens))
        .withColumn("tokens_per_second", F.col("tokens") / F.greatest(elapsed, F.lit(1e-6)))
    )


def every(steps: DataFrame, interval: int) -> DataFrame:
    """Only the steps at which something is logged, evaluated or saved."""
    return steps.where(F.col("step") % interval == 0)


def throughput(micro: DataFrame) -> DataFrame:
    """Tokens per second since the run was last (re)started.

    ``micro`` holds ``(run, restart, seq, at, tokens)``. Cumulative, not windowed: a resumed run
    counts from its resumption.
    """
    counted = running_total(micro, "seq", "tokens", "before", ["run", "restart"], first={"started": "at"})
    seconds = (F.col("at") - F.col("started")) / F.lit(1_000_000.0)
    tokens = F.col("before") + F.col("tokens")
    return counted.select(
        "run", "restart", "seq", tokens.alias("tokens_since_start"), seconds.alias("seconds"),
        (tokens / F.greatest(seconds, F.lit(1e-6))).alias("tokens_per_second"),
    )


def tokens_seen(micro: DataFrame) -> DataFrame:
    """Add ``seen``: tokens of the run up to and including this row."""
    counted = running_total(micro, "seq", "tokens", "before", ["run"])
    return counted.withColumn("seen", F.col("before") + F.col("tokens")).drop("before")


def stop_points(micro: DataFrame, max_tokens: int) -> DataFrame:
    """Where each run reaches its budget; null where it never does."""
    seen = tokens_seen(micro)
    reached = F.col("seen") >= max_tokens
    return seen.groupBy("run").agg(
        F.min(F.when(reached, F.col("seq"))).alias("stop_seq"), F.min(F.when(reached, F.col("seen"))).alias("stop_tokens"),
        F.max("seen").alias("tokens"),
    )


def validation_loss(batch_losses: DataFrame, max_batches: int, has_data: bool = True) -> DataFrame:
    """Mean over the first ``max_batches`` losses of a run; NaN without data, 0 without batches."""
    if not has_data:
        return batch_losses.select("run").distinct().withColumn("val_loss", F.lit(float("nan")))
    if max_batches <= 0:
        none = F.lit(0).cast("bigint").alias("n_batches")
        return batch_losses.select("run").distinct().select("run", F.lit(0.0).alias("val_loss"), none)
    # A rank with a bound becomes a group limit before the shuffle, so a long run sends few rows.
    place = F.row_number().over(W.partitionBy("run").orderBy("seq"))
    first = batch_losses.select("run", "seq", "loss").withColumn("place", place).where(F.col("place") <= max_batches)
    return first.groupBy("run").agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("val_loss"), F.count("loss").alias("n_batches"))


def metrics_long(steps: DataFrame, names: list[str]) -> DataFrame:
    """``(run, step, metric, value)``."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return steps.select("run", "step", F.inline(entries))
