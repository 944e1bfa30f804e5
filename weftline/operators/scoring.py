"""Requests to token positions, token scores to request scores, request scores to accuracy.

The boundary to a model is a table ``(request_id, pos, token, logprob, argmax_token)``; any scorer
that makes it can be used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.math import share
from weftline.functions.text import keep_last
from weftline.session import ship_package

SCORE_SCHEMA = "request_id string, pos int, token int, logprob double, argmax_token int"


def _targets(frame: DataFrame, ids: Column, n_targets: Column, keep: list[str]) -> DataFrame:
    """One row per scored position: ``pos``, ``prev`` (the id before it) and ``token``.

    Positions with nothing before them cannot be scored and are left out; a request with no position
    at all keeps one row with nulls, so that it is still counted.
    """
    shaped = frame.withColumn("_ids", ids).withColumn("_n", n_targets)
    first = F.greatest(F.size("_ids") - F.col("_n"), F.lit(1))
    places = F.when(first < F.size("_ids"), F.sequence(first, F.size("_ids") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    rows = F.transform(
        places,
        lambda i: F.struct(
            (i - (F.size("_ids") - F.col("_n"))).alias("pos"),
            F.get("_ids", i - 1).alias("prev"),
            F.get("_ids", i).alias("token"),
        ),
    )
    return shaped.select("request_id", *keep, F.col("_n").alias("n_expected"), F.explode_outer(rows).alias("_t")).select(
        "request_id", *keep, "n_expected", "_t.pos", "_t.prev", "_t.token"
    )


def continuation_targets(requests: DataFrame, max_length: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Positions of the continuation; with ``max_length``, a longer request keeps its last ids."""
    joined = F.concat("ctx_ids", "cont_ids")
    ids = joined if max_length is None else keep_last(joined, max_length)
    return _targets(requests, ids, F.size("cont_ids"), list(keep))


def rolling_targets(texts: DataFrame, max_length: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Every position after the first of ``ids``; texts under two ids have none."""
    ids = F.col("ids") if max_length is None else keep_last(F.col("ids"), max_length)
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return _targets(texts, ids, n, list(keep))


def score_with(requests: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str = SCORE_SCHEMA) -> DataFrame:
    """Run a caller's model over batches of requests; it returns token-score rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return requests.mapInPandas(run, schema)


#: ``(ids, lengths)`` to ``(logprob, argmax)``: matrices of one row a request; what stands behind a row's length is padding.
PaddedModel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_loaded: dict[str, PaddedModel] = {}


def _model(name: str, load: Callable[[], PaddedModel]) -> PaddedModel:
    """The model called ``name`` of this worker; later tasks of the worker find it there. One is kept at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = load()
    return _loaded[name]


def padded_batches(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of ascending ``lengths`` whose padded matrix holds at most ``most`` ids; a longer row is alone."""
    start = 0
    for end in range(1, len(lengths) + 1):
        if end == len(lengths) or (end + 1 - start) * int(lengths[end]) > most:
            yield slice(start, end)
            start = end


def score_padded(
    requests: DataFrame,
    load: Callable[[], PaddedModel],
    max_length: int | None = None,
    batch_ids: int = 65_536,
    pad_id: int = 0,
) -> DataFrame:
    """Token scores of the continuations by a caller's model that takes padded batches.

    ``load`` runs once in each Python worker. Requests are ordered by length inside their partition (no shuffle),
    so a batch holds rows of like length and little padding; ``batch_ids`` bounds its matrix. With ``max_length`` a
    longer request keeps its last ids. ``logprob[r, i]`` and ``argmax[r, i]`` are about ``ids[r, i]`` after the
    ids before it. Requests without a position to score (no continuation, nothing before it, null ids) have no row here;
    ``gather_scores`` keeps them.
    """
    ship_package(requests.sparkSession)
    joined = F.concat("ctx_ids", "cont_ids")
    kept = requests.select(
        "request_id", (joined if max_length is None else keep_last(joined, max_length)).alias("ids"), F.size("cont_ids").alias("n")
    ).where((F.size("ids") > 1) & (F.col("n") > 0))
    name = uuid.uuid4().hex
    id_type = requests.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(1), batch.column(2).to_numpy()
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
            lengths = np.diff(ends)
            for part in padded_batches(lengths, batch_ids):
                size = lengths[part]
                inside = np.arange(size.max())[None, :] < size[:, None]
                matrix = np.full(inside.shape, pad_id, np.int32)
                matrix[inside] = flat[ends[part.start] : ends[part.stop]]
                logprob, argmax = _model(name, load)(matrix, size)
                begin = size - n[part]
                row, at = np.nonzero(inside & (np.arange(inside.shape[1])[None, :] >= np.maximum(begin, 1)[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + part.start)),
                        pa.array((at - begin[row]).astype(np.int32)),
                        pa.array(matrix[row, at]),
                        pa.array(np.asarray(logprob, np.float64)[row, at]),
                        pa.array(np.asarray(argmax, np.int32)[row, at]),
                    ],
                    ["request_id", "pos", "token", "logprob", "argmax_token"],
                )

    ordered = kept.sortWithinPartitions(F.size("ids"))
    return ordered.mapInArrow(run, f"request_id {id_type}, pos int, token int, logprob double, argmax_token int")


def gather_scores(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the wanted tokens out of a table that may hold other positions and candidates."""
    wanted = scores.select("request_id", "pos", "token", "logprob", "argmax_token")
    return targets.join(wanted, ["request_id", "pos", "token"], "left")


def top_tokens(candidates: DataFrame) -> DataFrame:
    """Best candidate of each position; equal scores go to the lowest id."""
    best = F.max_by("token", F.struct("logprob", -F.col("token")))
    return candidates.groupBy("request_id", "pos").agg(best.alias("argmax_token"))


def request_scores(token_scores: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``ll``, ``is_greedy`` and counts per request; no positions give 0 and true."""
    return token_scores.groupBy("request_id", *keep).agg(
        F.coalesce(F.sum("logprob"), F.lit(0.0)).alias("ll"),
        F.coalesce(F.bool_and(F.col("argmax_token") == F.col("token")), F.lit(True)).alias("is_greedy"),
        F.max("n_expected").cast("bigint").alias("n_expected"),
        F.count("logprob").alias("n_scored"),
    )


def per_token(scores: DataFrame, extra: int = 0) -> DataFrame:
    """Add ``score``: likelihood over length (``extra`` = 1 where the divisor counts the first id too)."""
    return scores.withColumn("score", F.col("ll") / F.greatest(F.col("n_expected") + extra, F.lit(1)))


def chosen(scores: DataFrame) -> DataFrame:
    """The best choice of each item, the first of equals: ``(item_id, label, picked, correct)``.

    Scores are compared to nine places: sums of the same terms in another order must stay equal.
    """
    picked = F.max_by("choice_idx", F.struct(F.round("score", 9), -F.col("choice_idx")))
    return scores.groupBy("item_id", "label").agg(picked.alias("picked")).withColumn(
        "correct", F.col("picked") == F.col("label")
    )


def accuracy(outcomes: DataFrame, by: Iterable[str] = (), correct: str = "correct") -> DataFrame:
    """Right answers over all answers; no answers give 0."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0)).alias("n_correct")
    ).withColumn("accuracy", share(F.col("n_correct"), F.col("total")))


def accuracy_of_tasks(outcomes: DataFrame, tasks: list[str]) -> DataFrame:
    """Accuracy of exactly these tasks; one without outcomes gets 0."""
    listed = outcomes.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    found = accuracy(outcomes.where(F.col("task").isin(tasks)), ["task"])
    return listed.join(found, "task", "left").fillna(0, ["total", "n_correct", "accuracy"])


def perplexity_of(scores: DataFrame) -> DataFrame:
    """Add ``perplexity`` of rolling scores; texts without positions have none."""
    return scores.withColumn("perplexity", F.when(F.col("n_scored") > 0, F.exp(-F.col("ll") / F.col("n_scored"))))


def preferred_metric(metrics: str = "metrics", names: Iterable[str] = ("acc,none", "acc_norm,none")) -> Column:
    """The first of the named metrics that a task reports."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(name)) for name in names])
