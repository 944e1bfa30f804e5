"""Token spans to fixed-length training blocks.

A document knows its global interval, so it can name the blocks it touches by arithmetic and send
each one just its own slice: no range join, work proportional to tokens, and never more than one
block's tokens in a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.corpus import cut_at, spans_within


def slices(spans: DataFrame, stride: int, length: int, name: str = "block_id") -> DataFrame:
    """``(name, lo, piece)``: the part of each span that falls in window ``k`` = ``[k*stride, k*stride+length)``."""
    start, end = "start", "(start + n_tokens)"
    lowest = f"greatest(0, start - {length - stride}) div {stride}"
    highest = f"({end} - 1) div {stride}"
    piece = f"""
        struct(
            k AS {name},
            greatest({start}, k * {stride}) AS lo,
            slice(
                ids,
                int(greatest(0, k * {stride} - {start})) + 1,
                int(least({end}, k * {stride} + {length}) - greatest({start}, k * {stride}))
            ) AS piece
        )"""
    return spans.where("n_tokens > 0").select(F.expr(f"inline(transform(sequence({lowest}, {highest}), k -> {piece}))"))


def _join_pieces() -> Column:
    """Pieces of one window in stream order; ``collect_list`` alone has no order."""
    ordered = F.sort_array(F.collect_list(F.struct("lo", "piece")))
    return F.flatten(F.transform(ordered, lambda p: p["piece"]))


def windows(spans: DataFrame, stride: int, length: int) -> DataFrame:
    """``(block_id, tokens)``, the short windows at the end of the stream included."""
    return slices(spans, stride, length).groupBy("block_id").agg(_join_pieces().alias("tokens"))


def _full_blocks(spans: DataFrame, stride: int, length: int) -> DataFrame:
    """Complete windows only, which is what drops the remainder at the end of the stream."""
    return windows(spans, stride, length).where(F.size("tokens") == length)


def overlapping_blocks(spans: DataFrame, seq_len: int, max_tokens: int | None = None) -> DataFrame:
    """Blocks of ``seq_len + 1`` tokens at stride ``seq_len``: neighbours share one token.

    ``max_tokens`` of 0 or ``None`` means all tokens.
    """
    if max_tokens:
        spans = cut_at(spans, max_tokens)
    return _full_blocks(spans, seq_len, seq_len + 1)


def disjoint_blocks(spans: DataFrame, seq_len: int, max_tokens: int | None = None) -> DataFrame:
    """Blocks of ``seq_len + 1`` tokens that share nothing, as the streaming reader makes them.

    Production stops with the block at which ``seq_len`` tokens per block reach ``max_tokens``.
    """
    if max_tokens:
        spans = cut_at(spans, -(-max_tokens // seq_len) * (seq_len + 1))
    return _full_blocks(spans, seq_len + 1, seq_len + 1)


def blocks_between(encoded: DataFrame, first: int, last: int, seq_len: int) -> DataFrame:
    """Overlapping blocks ``first`` to ``last - 1`` only, from the documents they touch."""
    low, high = first * seq_len, last * seq_len + 1
    return _full_blocks(spans_within(encoded, low, high), seq_len, seq_len + 1).where(
        (F.col("block_id") >= first) & (F.col("block_id") < last)
    )


def num_overlapping_blocks(total: int, seq_len: int, max_tokens: int | None = None) -> int:
    served = min(max_tokens, total) if max_tokens else total
    return max(served - 1, 0) // seq_len


def next_token_pairs(blocks: DataFrame) -> DataFrame:
    """``(block_id, input_ids, labels)``: labels are the inputs moved by one."""
    length = F.size("tokens") - 1
    return blocks.select(
        "block_id",
        F.slice("tokens", F.lit(1), length).alias("input_ids"),
        F.slice("tokens", F.lit(2), length).alias("labels"),
    )
