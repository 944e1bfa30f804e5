"""Incremental work: what is left to do, and what cannot be done yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finished(metrics: DataFrame, key: str, tasks: Sequence[str]) -> DataFrame:
    """Keys for which every expected task has been reported."""
    wanted = metrics.where(F.col("task").isin(list(tasks)))
    return wanted.groupBy(key).agg(F.count_distinct("task").alias("_n")).where(F.col("_n") == len(tasks)).select(key)


def remaining(inputs: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inputs without a finished output."""
    return inputs.join(done.select(*on), list(on), "left_anti")


def runnable(plan: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned work whose input exists."""
    return plan.join(available.select(*on), list(on), "left_semi")


def missing(plan: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned work whose input does not exist."""
    return plan.join(available.select(*on), list(on), "left_anti")
