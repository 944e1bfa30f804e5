"""Fixed-size shards over the token stream: budget, assignment, manifest, range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.corpus import cut_at
from weftline.operators.packing import slices
from weftline.operators.prefix import RANGE, range_cuts, with_range
from weftline.session import stage

# Fixed value: tokens per published shard.
SHARD_TOKENS = 100_000_000


def kept_tokens(available: int, shard_size: int, budget: int) -> int:
    """Tokens that reach the shards.

    The budget is looked at after each whole shard, so whole shards may pass it; only a last partial
    shard is trimmed to it.
    """
    whole = min(available // shard_size, -(-budget // shard_size)) * shard_size
    if whole >= budget:
        return whole
    return whole + min(available - whole, budget - whole)


def shard_pieces(spans: DataFrame, shard_size: int, kept: int | None = None) -> DataFrame:
    """``(shard_id, lo, piece)``: each document's tokens, split where a shard ends."""
    if kept is not None:
        spans = cut_at(spans, kept)
    return slices(spans, shard_size, shard_size, "shard_id")


def shard_assignment(offsets: DataFrame, shard_size: int, kept: int | None = None) -> DataFrame:
    """``(doc_id, shard_id, lo, n_tokens)`` from offsets alone; tokens are not needed."""
    if kept is not None:
        offsets = cut_at(offsets, kept)
    return offsets.where("n_tokens > 0").select(
        "doc_id",
        F.expr(
            f"""inline(transform(
                sequence(start div {shard_size}, (start + n_tokens - 1) div {shard_size}),
                k -> struct(
                    k AS shard_id,
                    greatest(start, k * {shard_size}) AS lo,
                    least(start + n_tokens, (k + 1) * {shard_size}) - greatest(start, k * {shard_size}) AS n_tokens
                )))"""
        ),
    )


def shard_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("shard_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))


def shard_offsets(sizes: DataFrame) -> DataFrame:
    """Where each shard begins; the input is a manifest, one row per shard file."""
    before = W.orderBy("shard_id").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def locate_positions(positions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shard and local position of each ``pos`` for shards of any size; positions in no shard, and null ones, are left out.

    A merge of two sides in one order: starts and positions are dealt together to ranges of ``pos``, each position
    takes the last start before it in its range, or else the last start of the ranges before. Neither side has a
    limit and no start reaches the driver; equal positions share a range.
    """
    start, mark = F.col("start"), F.struct("start", "n_tokens", "shard_id")
    starts = manifest.where("n_tokens > 0").select(start.cast("bigint").alias("pos"), mark.alias("_shard"))
    both = positions.where("pos >= 0").withColumn("_place", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    both = stage(both, "positions")  # read for the cuts, the ranges' last starts and the merge
    ranged = with_range(both, "pos", range_cuts(both, "pos"))
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    last = ranged.groupBy(RANGE).agg(F.max("_shard").alias("_last"))
    # one row a range, and range_cuts sets their number
    carried = F.broadcast(last.select(RANGE, F.max("_last").over(before).alias("_carried")))
    inside = W.partitionBy(RANGE).orderBy(F.col("pos"), F.col("_place").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    met = ranged.withColumn("_shard", F.last("_shard", ignorenulls=True).over(inside)).where("_place").join(carried, RANGE)
    found = met.withColumn("_shard", F.coalesce("_shard", "_carried")).where(F.col("pos") < F.col("_shard.start") + F.col("_shard.n_tokens"))
    placed = found.withColumns({"shard_id": F.col("_shard.shard_id"), "local_pos": F.col("pos") - F.col("_shard.start")})
    return placed.drop(RANGE, "_shard", "_place", "_carried")


def manifest_row(sizes: DataFrame, **facts: object) -> DataFrame:
    """One row: totals measured from the shards plus the given facts (vocabulary, end id, names)."""
    return sizes.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"),
        F.count(F.lit(1)).alias("num_shards"),
    ).select("*", F.lit("uint16").alias("dtype"), *[F.lit(value).alias(name) for name, value in facts.items()])


def read_range(spans: DataFrame, first: int, count: int) -> DataFrame:
    """``(pos, token)`` for ``[first, first + count)``, whatever documents or shards it crosses.

    Spans outside the range go before anything is unpacked.
    """
    touching = spans.where((F.col("start") < first + count) & (F.col("start") + F.col("n_tokens") > first))
    return touching.select("start", F.posexplode("ids").alias("i", "token")).select(
        (F.col("start") + F.col("i")).alias("pos"), "token"
    ).where(F.col("pos").between(first, first + count - 1))
