"""A count-based scorer, standing in for a neural model in checks.

``P(token | prev) = (n(prev, token) + 1) / (n(prev) + V)``; the predicted token is the most frequent
successor, the lowest id among equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import keep_last
from weftline.operators.corpus import END_ID, LARGEST_ID, TOKENS_AT_ONCE, VOCABULARY_SIZE, row_pieces
from weftline.session import small_batches, stage

HOT_SHARE = 1_000
#: The most frequent pairs that every task holds: 16 bytes each.
PAIRS_SENT = 500_000
LARGEST_COUNT = (1 << 63) - 1


@dataclass(frozen=True)
class Bigrams:
    pairs: DataFrame
    size: int = VOCABULARY_SIZE


def open_ids(encoded: DataFrame) -> DataFrame:
    """Encoded documents without their end markers, as ``(doc_id, ids)``."""
    return encoded.select("doc_id", F.slice("ids", F.lit(1), F.col("n_tokens").cast("int") - 1).alias("ids"))


def _pair_keys(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids of each row as one number, and the row that each pair is of."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    same = row[1:] == row[:-1]
    return (flat[:-1][same] << 16) | flat[1:][same], row[1:][same]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def counted() -> pa.RecordBatch:
        parts = [(keys >> 16).astype(np.int32), (keys & LARGEST_ID).astype(np.int32), counts]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["prev", "token", "n"])

    for batch in batches:
        for piece in row_pieces(batch.column(0)):
            k, c = np.unique(_pair_keys(piece)[0], return_counts=True)
            keys, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, np.concatenate([counts, c]))
            counts = total
            if len(keys) > TOKENS_AT_ONCE:
                yield counted()
                keys, counts = keys[:0], counts[:0]
    yield counted()
    pa.default_memory_pool().release_unused()


def fit_bigrams(encoded: DataFrame) -> Bigrams:
    """Count neighbouring ids. Each task counts its own batches first; sums are written once and all uses read the table."""
    counted = open_ids(encoded).select("ids").mapInArrow(_count_pairs, "prev int, token int, n bigint")
    with small_batches(encoded.sparkSession):
        return Bigrams(stage(counted.groupBy("prev", "token").agg(F.sum("n").alias("n")), "bigrams"))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least count at which no more than ``most`` pairs stand; there are few different counts."""
    reached = F.sum("m").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    per_count = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("m")).withColumn("reached", reached)
    least = per_count.where(F.col("reached") <= most).agg(F.min("n")).first()[0]
    return LARGEST_COUNT if least is None else least


def rolling_scores(texts: DataFrame, model: Bigrams, max_length: int | None = None) -> DataFrame:
    """``(request_id, ll, n_scored)`` of every id after the first of ``(request_id, ids)``, as ``rolling_targets`` and ``bigram_scores`` give.

    A text stays one row: its pairs are looked up in the most frequent ones where it lies, and only pairs that are
    not among these become rows and are joined.
    """
    spark = texts.sparkSession
    least = _frequent(model.pairs, PAIRS_SENT)
    totals = model.pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    key = (F.shiftleft(F.col("prev").cast("bigint"), 16) + F.col("token")).alias("key")

    def logprob(n):
        return F.log((n + 1) / (F.coalesce("n_prev", F.lit(0)) + F.lit(model.size))).alias("ll")

    often = model.pairs.where(F.col("n") >= least).join(F.broadcast(totals), "prev").select(key, logprob(F.col("n"))).orderBy("key").toArrow()
    sent = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("ll").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lls = sent.value
        for batch in batches:
            done = 0
            for piece in row_pieces(batch.column(1)):
                pairs, row = _pair_keys(piece)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                ll = np.bincount(row[found], lls[at[found]], len(piece))
                rest = np.append(0, np.cumsum(np.bincount(row[~found], minlength=len(piece))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(piece)),
                        pa.array(ll.astype(np.float64)),  # of nothing, bincount gives integers
                        pa.array(np.bincount(row, minlength=len(piece)).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(pairs[~found])),
                    ],
                    ["request_id", "ll", "n_scored", "rest"],
                )
                done += len(piece)
        pa.default_memory_pool().release_unused()

    ids = F.col("ids") if max_length is None else keep_last(F.col("ids"), max_length)
    id_type = texts.schema["request_id"].dataType.simpleString()
    looked_up = texts.select("request_id", ids.alias("ids")).mapInArrow(run, f"request_id {id_type}, ll double, n_scored bigint, rest array<bigint>")
    with small_batches(spark):
        looked_up = stage(looked_up, "rolling")
    rare = model.pairs.where(F.col("n") < least).select(key, "n")
    rest = looked_up.select("request_id", F.explode("rest").alias("key")).join(rare, "key", "left")
    rest = rest.withColumn("prev", F.shiftright("key", 16).cast("int")).join(F.broadcast(totals), "prev", "left")
    parts = looked_up.select("request_id", "ll", "n_scored").unionByName(
        rest.select("request_id", logprob(F.coalesce("n", F.lit(0))), F.lit(0).cast("bigint").alias("n_scored"))
    )
    return parts.groupBy("request_id").agg(F.sum("ll").alias("ll"), F.sum("n_scored").alias("n_scored"))


def bigram_scores(targets: DataFrame, model: Bigrams) -> DataFrame:
    """Add ``logprob`` and ``argmax_token`` to ``(prev, token)`` rows.

    * Totals per ``prev`` are at most one row per vocabulary entry: broadcast.
    * Pairs above 1/1000 of all occurrences are fewer than 1000 rows: broadcast, and their target
      rows get a random salt that matches nothing, so a hot pair cannot pile up in one task of the
      remaining join.
    """
    pairs, known = model.pairs, F.col("token").isNotNull()
    # Count and id packed into one number: its maximum is a hash aggregate, a maximum of structs is a sort.
    packed = F.shiftleft("n", 16) + (LARGEST_ID - F.col("token"))
    best_id = (LARGEST_ID - F.max(packed).bitwiseAND(F.lit(LARGEST_ID))).cast("int")
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"), best_id.alias("argmax_token"))
    limit = (pairs.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = pairs.where(F.col("n") > limit).select("prev", "token", F.col("n").alias("n_hot"))
    cold = pairs.where(F.col("n") <= limit).withColumn("salt", F.lit(0))

    seen = targets.join(F.broadcast(totals), "prev", "left").join(F.broadcast(hot), ["prev", "token"], "left")
    spread_out = F.col("n_hot").isNotNull() | ~known
    salt = F.when(spread_out, 1 + F.pmod(F.xxhash64("request_id", "pos"), F.lit(1_000_000))).otherwise(0).cast("int")
    scored = seen.withColumn("salt", salt).join(cold, ["prev", "token", "salt"], "left")
    count = F.coalesce("n_hot", "n", F.lit(0))
    logprob = F.log((count + 1) / (F.coalesce("n_prev", F.lit(0)) + F.lit(model.size)))
    best = F.coalesce("argmax_token", F.lit(END_ID))
    return scored.withColumn("logprob", F.when(known, logprob)).withColumn(
        "argmax_token", F.when(known, best)
    ).drop("n", "n_hot", "n_prev", "salt")
