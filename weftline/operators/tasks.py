"""Benchmark tasks by name: items to right-or-wrong outcomes, with any tokenizer and any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import requests as R
from weftline.operators import scoring as X
from weftline.operators.corpus import Encoder

# Targets in, the same rows with ``logprob`` and ``argmax_token`` out.
Scorer = Callable[[DataFrame], DataFrame]
CHOICE = ["item_id", "choice_idx", "label"]


def last_word(items: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    requests = R.encode_requests(R.last_word_requests(items), encode)
    folded = X.request_scores(score(X.continuation_targets(requests, R.MAX_LENGTH)))
    return folded.select(F.col("is_greedy").alias("correct"))


def _pick(requests: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    targets = X.continuation_targets(R.encode_requests(requests, encode), R.MAX_LENGTH, CHOICE)
    return X.chosen(X.per_token(X.request_scores(score(targets), CHOICE))).select("correct")


def endings(items: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    return _pick(R.ending_requests(items), encode, score)


def questions(items: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    return _pick(R.question_requests(items), encode, score)


def blanks(items: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    texts = R.blank_requests(items).withColumn("ids", encode.ids(F.col("text"))).drop("text")
    folded = X.request_scores(score(X.rolling_targets(texts, R.MAX_LENGTH, CHOICE)), CHOICE)
    return X.chosen(X.per_token(folded, extra=1)).select("correct")


def needles(cases: DataFrame, encode: Encoder, score: Scorer) -> DataFrame:
    """Needle cases ``(case_id, context_len, prompt, answer)``: the top-1 after the prompt is the answer's first token."""
    requests = cases.select(
        F.concat_ws(":", F.col("case_id").cast("string"), F.col("context_len").cast("string")).alias("request_id"),
        encode.ids(F.array_join("prompt", " ")).alias("ctx_ids"),
        F.slice(encode.ids(F.concat(F.lit(" "), "answer")), F.lit(1), F.lit(1)).alias("cont_ids"),
    )
    folded = X.request_scores(score(X.continuation_targets(requests)))
    return folded.select(F.col("is_greedy").alias("correct"))


# The names the tasks are asked for by.
RUNNERS = {
    "lambada": last_word,
    "niah": needles,
    "hellaswag": endings,
    "arc_easy": questions,
    "winogrande": blanks,
}


def evaluate(inputs: dict[str, DataFrame], encode: Encoder, score: Scorer, tasks: Iterable[str] | None = None) -> DataFrame:
    """``(task, total, n_correct, accuracy)`` of the asked tasks, as one job over all of them.

    A task without items reports 0; a name that is no task is an error.
    """
    tasks = list(tasks or RUNNERS)
    if unknown := [task for task in tasks if task not in RUNNERS]:
        raise ValueError(f"no such tasks: {unknown}")
    outcomes = None
    for task in tasks:
        if task in inputs:
            part = RUNNERS[task](inputs[task], encode, score).withColumn("task", F.lit(task))
            outcomes = part if outcomes is None else outcomes.unionByName(part)
    if outcomes is None:
        raise ValueError(f"no items for any of {tasks}")
    return X.accuracy_of_tasks(outcomes, tasks)
