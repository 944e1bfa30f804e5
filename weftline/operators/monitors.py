"""Per-layer and per-head diagnostics, finiteness and range checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.math import half_life, is_finite, softplus

# Ranges that count as healthy.
LARGEST_GAP = 20.0
HALF_LIFE_RANGE = (10.0, 200.0)
PARAMETER_TOLERANCE = 0.01


def layer_scale_summary(raw: DataFrame) -> DataFrame:
    """``(layer, values)`` to mean and population spread of softplus, flagging layers that never moved.

    A layer whose raw values are all equal has no spread: it gets an exact 0 and a flag, not
    rounding noise.
    """
    heads = raw.select("layer", F.explode("values").alias("raw"))
    summary = heads.groupBy("layer").agg(
        F.avg(softplus(F.col("raw"))).alias("mean"),
        F.stddev_pop(softplus(F.col("raw"))).alias("_std"),
        (F.min("raw") == F.max("raw")).alias("is_constant"),
        F.count(F.lit(1)).alias("n_heads"),
    )
    return summary.withColumn("std", F.when(F.col("is_constant"), F.lit(0.0)).otherwise(F.col("_std"))).drop("_std")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    """Array of scores to probabilities, shifted by the largest score."""
    return _bound(
        F.array_max(values),
        lambda top: _bound(
            F.transform(values, lambda x: F.exp(x - top)),
            lambda weights: _bound(_total(weights), lambda total: F.transform(weights, lambda w: w / total)),
        ),
    )


def attention_entropy(rows: DataFrame) -> DataFrame:
    """``(layer, probs)`` to the mean entropy of each layer; a zero probability adds nothing."""
    terms = F.transform("probs", lambda p: F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)))
    return rows.select("layer", _total(terms).alias("h")).groupBy("layer").agg(
        F.avg("h").alias("entropy"), F.count(F.lit(1)).alias("n_rows")
    )


def layer_monitors(rows: DataFrame) -> DataFrame:
    """``(layer, g, c, log_decay)`` to the largest gap between g and c, and the half-life of the decay."""
    return rows.groupBy("layer").agg(
        F.max(F.abs(F.col("g") - F.col("c"))).alias("max_gap"), half_life(F.avg("log_decay")).alias("half_life")
    )


def monitor_keys(monitors: DataFrame) -> DataFrame:
    """Wide monitor rows to ``(metric, value)`` under their logged names."""
    layer = F.col("layer").cast("string")
    entries = F.array(
        F.struct(F.concat(F.lit("monitor/max_g_c_L"), layer).alias("metric"), F.col("max_gap").alias("value")),
        F.struct(F.concat(F.lit("monitor/half_life_L"), layer).alias("metric"), F.col("half_life").alias("value")),
    )
    return monitors.select(F.inline(entries))


def head_scales(heads: DataFrame) -> DataFrame:
    """``(layer, head, raw)`` to the positive scale of each head: softplus of the mean of its raw values."""
    return heads.groupBy("layer", "head").agg(softplus(F.avg("raw")).alias("scale"))


def head_keys(scales: DataFrame) -> DataFrame:
    """Scales per head to ``(metric, value)`` under their logged names."""
    name = F.concat(F.lit("lambda/L"), F.col("layer").cast("string"), F.lit("_H"), F.col("head").cast("string"))
    return scales.select(name.alias("metric"), F.col("scale").alias("value"))


def parse_monitor_keys(metrics: DataFrame) -> DataFrame:
    """``(metric, value)`` to ``(name, layer, head, value)``; keys of other kinds are left out."""
    key = F.col("metric")
    layer = F.regexp_extract(key, r"[_/]L(\d+)(?:_H\d+)?$", 1)
    head = F.regexp_extract(key, r"_H(\d+)$", 1)
    return metrics.where(layer != "").select(
        F.regexp_replace(key, r"[_/]L\d+(_H\d+)?$", "").alias("name"),
        layer.cast("int").alias("layer"),
        F.when(head != "", head).cast("int").alias("head"),
        "value",
    )


def finite_check(rows: DataFrame, by: Iterable[str] = (), value: str = "value") -> DataFrame:
    """Counts of NaN, infinite and non-positive values."""
    x = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(F.abs(x) == float("inf")).alias("n_inf"),
        F.count_if(is_finite(x) & (x <= 0)).alias("n_not_positive"),
    ).withColumn("all_finite", (F.col("n_nan") == 0) & (F.col("n_inf") == 0))


def range_status(monitors: DataFrame) -> DataFrame:
    """OK or WARNING for each monitored range."""
    low, high = HALF_LIFE_RANGE

    def status(ok):
        return F.when(ok, "OK").otherwise("WARNING")

    checks = [status(F.col("max_gap") < LARGEST_GAP).alias("gap_status"),
              status((F.col("half_life") > low) & (F.col("half_life") < high)).alias("half_life_status")]
    return monitors.select("*", *checks)


def parameter_status(counts: DataFrame, base: str, other: str) -> DataFrame:
    """Whether two parameter counts agree within 1%; without a count to compare with they do not."""
    gap = F.try_divide(F.abs(F.col(other) - F.col(base)).cast("double"), F.col(base).cast("double"))
    return counts.select(
        "*", gap.alias("gap"), F.when(gap < PARAMETER_TOLERANCE, "OK").otherwise("WARNING").alias("parameter_status")
    )
