"""Seeded epoch shuffles, batches, repeated passes and validation splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.draws import draw_key
from weftline.functions.permutation import place_of
from weftline.operators.packing import next_token_pairs
from weftline.operators.prefix import hashed_rank


def shuffled_epochs(spark: SparkSession, num_blocks: int, epochs: int, seed: int) -> DataFrame:
    """``(epoch, block_id, place)``: a new permutation of all blocks for every pass.

    Only ids move; the blocks themselves are joined in by whoever needs them.
    """
    passes = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    keyed = spark.range(num_blocks).select(F.col("id").alias("block_id"), passes)
    keyed = keyed.withColumn("order_key", draw_key(seed, F.col("epoch"), F.col("block_id")))
    return hashed_rank(keyed, "order_key", "place", num_blocks, by=["epoch"]).drop("order_key")


def batches(places: DataFrame, num_blocks: int, micro_batch: int) -> DataFrame:
    """``(epoch, batch_id, slot, block_id)``; the short last batch of a pass is dropped."""
    return places.select(
        "epoch",
        F.expr(f"place div {micro_batch}").alias("batch_id"),
        (F.col("place") % micro_batch).alias("slot"),
        "block_id",
    ).where(F.col("batch_id") < num_blocks // micro_batch)


def training_batches(blocks: DataFrame, num_blocks: int, micro_batch: int, epochs: int, seed: int) -> DataFrame:
    """``(epoch, batch_id, slot, block_id, input_ids, labels)`` of all whole batches of ``epochs`` passes.

    Every pass is a computed permutation, so a block works its own place out where it lies: nothing is sorted, joined or
    shuffled, whatever the number of passes. Rows stay in the blocks' order; for rows in the order of the batches see
    ``read_training_batches``, which gives the same ones.
    """

    @F.arrow_udf("bigint")
    def place(block: pa.Array, epoch: pa.Array) -> pa.Array:
        block, epoch = block.to_numpy(), epoch.to_numpy()
        out = np.empty(len(block), np.int64)
        for e in np.unique(epoch).tolist():
            out[epoch == e] = place_of(block[epoch == e], num_blocks, seed, e)
        return pa.array(out)

    pairs = next_token_pairs(blocks.where(F.col("block_id") < num_blocks))
    passes = F.explode(F.array(*[F.lit(e) for e in range(epochs)]).cast("array<bigint>")).alias("epoch")
    placed = pairs.select("*", passes).withColumn("place", place("block_id", "epoch"))
    return placed.select(
        "epoch",
        F.expr(f"place div {micro_batch}").alias("batch_id"),
        (F.col("place") % micro_batch).alias("slot"),
        "block_id",
        "input_ids",
        "labels",
    ).where(F.col("batch_id") < num_blocks // micro_batch)


def training_schedule(
    spark: SparkSession, num_blocks: int, seq_len: int, micro_batch: int, accumulate: int, max_tokens: int, seed: int
) -> DataFrame:
    """Passes over the blocks until the token budget is used, with the step each batch belongs to.

    The budget is looked at only after a whole optimiser step, so the last step is always complete.
    """
    per_epoch = num_blocks // micro_batch
    if per_epoch == 0:
        raise ValueError("fewer blocks than one batch")
    steps = -(-max_tokens // (micro_batch * seq_len * accumulate))
    micro_batches = steps * accumulate
    epochs = max(1, -(-micro_batches // per_epoch))
    plan = batches(shuffled_epochs(spark, num_blocks, epochs, seed), num_blocks, micro_batch)
    number = F.col("epoch") * F.lit(per_epoch).cast("bigint") + F.col("batch_id")
    return plan.withColumn("micro_step", number).where(F.col("micro_step") < micro_batches).withColumn(
        "step", F.expr(f"micro_step div {accumulate} + 1")
    )


def head_range(num_blocks: int, micro_batch: int, max_batches: int) -> tuple[int, int]:
    """Blocks of the first ``max_batches`` whole batches in stream order (these are also trained on)."""
    return 0, min(max_batches, num_blocks // micro_batch) * micro_batch


def held_out_range(num_blocks: int, micro_batch: int, one_in: int = 20) -> tuple[int, int]:
    """Blocks of the whole batches in the last part (one in ``one_in``), disjoint from the rest."""
    return num_blocks - num_blocks // one_in // micro_batch * micro_batch, num_blocks


def in_stream_order(blocks: DataFrame, first: int, last: int, micro_batch: int) -> DataFrame:
    """Add ``batch_id`` and ``slot`` to blocks ``first`` to ``last - 1``, unshuffled."""
    return blocks.where((F.col("block_id") >= first) & (F.col("block_id") < last)).withColumn(
        "batch_id", F.expr(f"(block_id - {first}) div {micro_batch}")
    ).withColumn("slot", (F.col("block_id") - F.lit(first)) % micro_batch)
