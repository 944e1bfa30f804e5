"""Numeric columns used by telemetry, monitoring and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: losses above this are reported at exp(20).
LOSS_CEILING = 20.0


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(LOSS_CEILING)))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def half_life(mean_log_decay: Column) -> Column:
    """Steps until a decaying quantity halves; infinite where it does not decay."""
    return F.when(mean_log_decay < 0, F.lit(math.log(0.5)) / mean_log_decay).otherwise(F.lit(float("inf")))


def rate_factor(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear rise over ``warmup`` steps, then half a cosine down to zero."""
    progress = F.least((step - warmup) / F.lit(float(max(total - warmup, 1))), F.lit(1.0))
    falling = (F.cos(progress * math.pi) + 1.0) * 0.5
    return F.when(step < warmup, step / F.lit(float(max(warmup, 1)))).otherwise(falling)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` with an empty whole counting as zero, not as missing."""
    return F.coalesce(part, F.lit(0)).cast("double") / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def tokens_per_step(micro_batch: int, seq_len: int, accumulate: int) -> int:
    return micro_batch * seq_len * accumulate


def planned_steps(max_tokens: int, per_step: int) -> int:
    """Whole steps that fit in the budget."""
    return max_tokens // per_step


def steps_until_budget(max_tokens: int, per_step: int) -> int:
    """Steps actually taken: the budget is looked at only after a step is complete."""
    return -(-max_tokens // per_step)
