"""Result tables: unify, pivot, rank, compare, check.

A result row is ``(source, phase, model, step, tokens, <one column per task>)``; the long form has
``(…, task, score)``. These tables hold one row per evaluated checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The benchmark tasks in table order, and the default tokens per optimiser step.
TASKS = ("lambada", "niah", "hellaswag", "arc_easy", "winogrande")
STEP_TOKENS = 524_288

RUN = ("phase", "model", "step")


def union_results(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of all parts under their source name; columns a part lacks are null. Nothing is merged."""
    named = [part.withColumn("source", F.lit(name)) for name, part in parts.items()]
    whole = named[0]
    for part in named[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def fill_tokens(results: DataFrame, step_tokens: Column | int = STEP_TOKENS) -> DataFrame:
    """Missing token counts from the step and the run's own tokens per step."""
    per_step = F.lit(step_tokens) if isinstance(step_tokens, int) else step_tokens
    return results.withColumn("tokens", F.coalesce("tokens", F.col("step") * per_step))


def to_long(wide: DataFrame, tasks: Sequence[str] = TASKS) -> DataFrame:
    """One row per reported score."""
    others = [c for c in wide.columns if c not in tasks]
    return wide.unpivot(others, list(tasks), "task", "score").where(F.col("score").isNotNull())


def to_wide(long: DataFrame, by: Sequence[str] = RUN, tasks: Sequence[str] = TASKS) -> DataFrame:
    """Leaderboard: one column per task. The task list is given, so no pass is spent finding it."""
    return long.groupBy(*by).pivot("task", list(tasks)).agg(F.first("score"))


def final_rows(results: DataFrame, by: Sequence[str] = ("phase", "model")) -> DataFrame:
    """The last checkpoint of each model."""
    rest = [c for c in results.columns if c not in by]
    last = F.max_by(F.struct(*rest), "step").alias("_row")
    return results.groupBy(*by).agg(last).select(*by, "_row.*")


def task_places(long: DataFrame, by: Sequence[str] = ("phase", "task")) -> DataFrame:
    """Dense rank within each column of the leaderboard, and the best and second-best marks."""
    place = F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc("score")))
    return long.withColumn("place", place).withColumn(
        "mark", F.when(F.col("place") == 1, "best").when(F.col("place") == 2, "second").otherwise("")
    )


def versus_baseline(long: DataFrame, baseline: str, on: Sequence[str] = ("phase", "step", "task")) -> DataFrame:
    """Percentage points and relative change against one model."""
    base = long.where(F.col("model") == baseline).select(*on, F.col("score").alias("base_score"))
    gap = F.col("score") - F.col("base_score")
    return long.where(F.col("model") != baseline).join(base, list(on)).withColumns(
        {"points": gap * 100, "relative": F.when(F.col("base_score") != 0, gap / F.col("base_score"))}
    )


def first_step_reaching(long: DataFrame, thresholds: DataFrame, on: Sequence[str] = ("phase", "task")) -> DataFrame:
    """First step of each model whose score is at least ``threshold``; null where it never is."""
    reached = F.when(F.col("score") >= F.col("threshold"), F.col("step"))
    return long.join(thresholds, list(on)).groupBy(*on, "model").agg(
        F.first("threshold").alias("threshold"), F.min(reached).alias("first_step")
    )


def best_config(scores: DataFrame, config: str, by: Iterable[str] = ("phase",)) -> DataFrame:
    """The configuration with the highest score, the smallest among equals."""
    pick = F.max_by(config, F.struct("score", -F.col(config)))
    return scores.groupBy(*by).agg(pick.alias(config), F.max("score").alias("score"))


def token_mismatches(results: DataFrame, step_tokens: Column | int = STEP_TOKENS) -> DataFrame:
    """Rows whose token count is not step times the run's tokens per step."""
    per_step = F.lit(step_tokens) if isinstance(step_tokens, int) else step_tokens
    expected = F.col("step") * per_step
    return results.where(F.col("tokens") != expected).withColumns({"expected": expected, "excess": F.col("tokens") - expected})


def efficiency(finals: DataFrame, facts: DataFrame, metric: str) -> DataFrame:
    """Score points per thousand tokens/s and tokens per parameter; ``facts`` is one row per model."""
    joined = finals.join(facts, "model")
    return joined.withColumns(
        {
            "per_1k_tokens_per_second": F.col(metric) * 100 / (F.col("tokens_per_second") / 1000),
            "tokens_per_parameter": F.col("tokens") / F.col("parameters"),
        }
    )


def cost_ratio(costs: DataFrame, baseline: str, cost: str = "flops", by: Sequence[str] = ("phase",)) -> DataFrame:
    """Each model's cost over the baseline's."""
    base = costs.where(F.col("model") == baseline).select(*by, F.col(cost).alias("_base"))
    return costs.join(base, list(by), "left").withColumn("ratio", F.col(cost) / F.col("_base")).drop("_base")


def seed_summary(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """``(…, scores array)`` to mean and population standard deviation over seeds."""
    return scores.select(*by, F.explode("scores").alias("score")).groupBy(*by).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n_seeds")
    )


def parse_run_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """``[p<phase>_]<model>_step<step>`` to its parts."""
    pattern = r"^(?:p(\d+)_)?(.+)_step(\d+)$"
    phase, model, step = (F.regexp_extract(key, pattern, i) for i in (1, 2, 3))
    return keys.withColumns(
        {
            "phase": F.when(phase != "", phase).cast("int"),
            "model": model,
            "step": F.when(step != "", step).cast("bigint"),
        }
    )
