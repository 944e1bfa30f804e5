"""Bootstrap confidence intervals for accuracies.

Resampling ``n`` answers of which ``k`` are right gives a binomial count, so one resample is one
draw from that distribution: the cost per group is ``O(resamples + sqrt(n))`` whatever ``n`` is, and
the answers themselves are never repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.draws import DRAW_RANGE, draw

# Beyond this many standard deviations the binomial mass is below double precision.
SPREAD = 9.0


def outcome_counts(outcomes: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    """``(n, k)`` per group, combined map-side."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("k"))


def binomial_steps(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cumulative binomial probabilities ``(…, j, upto)`` for ``j`` within reach of ``k``.

    Relative weights follow from the ratio of neighbours, ``(n-j+1)/j * p/(1-p)``, added up as
    logarithms and normalised at the end, which needs no factorials.
    """
    reach = F.ceil(F.lit(SPREAD) * F.sqrt(F.col("k") * (F.col("n") - F.col("k")) / F.col("n")) + 1).cast("bigint")
    low, high = F.greatest(F.col("k") - reach, F.lit(0)), F.least(F.col("k") + reach, F.col("n"))
    grid = counts.where("k > 0 AND k < n").withColumn("low", low).withColumn("j", F.explode(F.sequence(low, high)))
    ratio = F.when(F.col("j") == F.col("low"), F.lit(0.0)).otherwise(
        F.log((F.col("n") - F.col("j") + 1) * F.col("k") / (F.col("j") * (F.col("n") - F.col("k"))))
    )
    group = W.partitionBy(*by)
    upto = group.orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    weights = grid.withColumn("log_w", F.sum(ratio).over(upto))
    weights = weights.withColumn("w", F.exp(F.col("log_w") - F.max("log_w").over(group)))
    return weights.select(*by, "j", (F.sum("w").over(upto) / F.sum("w").over(group)).alias("upto"))


def bootstrap_counts(counts: DataFrame, by: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """``(…, resample, k_star)``: the right answers of each resample, by inverse transform.

    Draws and cumulative steps are sorted together inside a group and each draw takes the next step
    at or above it: one sort instead of comparing every draw with every step.
    """
    names = list(by)
    rows = counts.select(*names, "n", "k", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = rows.withColumn("upto", (draw(seed, *[F.col(c) for c in names], F.col("resample")) + 0.5) / DRAW_RANGE)
    mixed = drawn.select(*names, "resample", "upto", F.lit(None).cast("bigint").alias("j")).unionByName(
        binomial_steps(counts, by).select(*names, F.lit(None).cast("int").alias("resample"), "upto", "j")
    )
    downward = W.partitionBy(*names).orderBy(F.desc("upto"), F.desc_nulls_last("j")).rowsBetween(W.unboundedPreceding, 0)
    found = mixed.withColumn("k_star", F.last("j", ignorenulls=True).over(downward)).where("resample IS NOT NULL")
    # Groups with no wrong or no right answer always resample to themselves.
    return found.join(counts.select(*names, "n", "k"), names).select(
        *names, "resample", "n", F.coalesce("k_star", "k").alias("k_star")
    )


def bootstrap_interval(
    counts: DataFrame, by: Sequence[str], resamples: int = 10_000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """``(…, n, accuracy, low, high)``: percentile interval of the resampled accuracies."""
    tail = (1 - level) / 2
    shares = F.percentile(F.col("k_star") / F.col("n"), F.array(F.lit(tail), F.lit(1 - tail)))
    ends = bootstrap_counts(counts, by, resamples, seed).groupBy(*by).agg(shares.alias("ends"))
    return counts.join(ends, list(by)).select(
        *by, "n", (F.col("k") / F.col("n")).alias("accuracy"), F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high")
    )


def overlap_verdict(intervals: DataFrame, group: str, baseline: str, on: Sequence[str]) -> DataFrame:
    """Each group's interval against the baseline's: overlapping intervals are not significant."""
    base = intervals.where(F.col(group) == baseline).select(*on, F.col("low").alias("base_low"), F.col("high").alias("base_high"))
    overlaps = F.greatest("low", "base_low") <= F.least("high", "base_high")
    return intervals.where(F.col(group) != baseline).join(base, list(on)).withColumn("overlaps", overlaps).withColumn(
        "verdict", F.when(overlaps, "not significant").otherwise("significant")
    )
