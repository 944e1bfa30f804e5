"""Seeded draws from hashes: the same in every engine, every partitioning and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def _parts(parts) -> list[Column]:
    return [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]


def draw_key(*parts) -> Column:
    """md5 of the colon-joined parts, as 32 hex digits."""
    return F.md5(F.concat_ws(":", *_parts(parts)))


def leading_bits(hex_key: Column) -> Column:
    """First 8 hex digits as an integer in ``[0, 2**32)``."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("bigint")


def draw(*parts) -> Column:
    """Uniform integer in ``[0, 2**32)``."""
    return leading_bits(draw_key(*parts))


def draw_between(low: Column, high: Column, *parts) -> Column:
    """Uniform integer in ``[low, high]``, both ends included."""
    return low + draw(*parts) % (high - low + F.lit(1))
