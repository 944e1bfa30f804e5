"""Running totals and ranks over data of any size.

A ``Window.orderBy`` without a partition pulls the whole table into one task, and a window
partitioned by a run pulls a hot run into one task. Where a group is too large for one task, it is
cut further into ranges of the order key:

1. per-range totals, combined map-side (one small row per range);
2. a running sum over those rows alone;
3. a window inside each range, plus the total of the ranges before it.

Cut points come from a sample of the order key, so skewed or sparse keys still give even ranges. The
sample only sets where the cuts fall: the result is the same for any cuts.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.draws import DRAW_RANGE, draw

RANGE = "_range"
ROWS_PER_RANGE = 200_000
WEIGHT_PER_RANGE = 50_000_000
SAMPLES_PER_RANGE = 200
MOST_HOT_GROUPS = 10_000


def _even_parts(df: DataFrame, rows: int) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(shuffle, rows), math.ceil(rows / ROWS_PER_RANGE))


def range_cuts(df: DataFrame, key: str, ranges: int | None = None, weight: str | None = None) -> list[float]:
    """Ascending cut points that split ``key`` into ranges of about equal row count, or of about equal ``weight``.

    ``weight`` names a size per row (tokens of a document, say). The sample then holds a row as often as its weight
    goes into a sample's share, so heavy rows lie in ranges of fewer rows wherever they are; a single row is not split.
    """
    heaviness = F.sum(weight) if weight else F.lit(0)
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(heaviness, F.lit(0))).first()
    ranges = ranges or max(_even_parts(df, rows), math.ceil(total / WEIGHT_PER_RANGE))
    if rows == 0 or ranges < 2:
        return []
    wanted = ranges * SAMPLES_PER_RANGE
    keys = df.select(F.col(key).cast("double").alias(key))
    if weight and total > 0:
        share = F.col(weight) * F.lit(wanted / total) + draw("cuts", F.col(key)) / F.lit(float(DRAW_RANGE))
        often = F.floor(F.greatest(share, F.lit(0.0))).cast("int")
        keys = df.select(F.col(key).cast("double").alias(key), F.explode(F.array_repeat(F.lit(0), often))).select(key)
    elif rows > wanted:
        keys = keys.sample(wanted / rows, seed=17)
    cuts = keys.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    return sorted(set(cuts))


def with_range(df: DataFrame, key: str, cuts: Sequence[float]) -> DataFrame:
    """Add the range number of ``key`` (a binary search over the cuts, done in the JVM)."""
    # Without cuts all keys are in range 0; a cut above every key keeps the number a computed column.
    ends = [-math.inf, *(cuts or [sys.float_info.max]), math.inf]
    finder = Bucketizer(splits=ends, inputCol=key, outputCol=RANGE)
    # A null key sorts first, so it belongs to the first range.
    return finder.transform(df).withColumn(RANGE, F.coalesce(F.col(RANGE).cast("int"), F.lit(0)))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys`` where null equals null; ``right`` gives its other columns only."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    # a range is never null; plain equality keeps the rows' partitioning by range
    same = [F.col(key) == F.col(f"_r_{key}") if key == RANGE else F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys]
    return left.join(renamed, same).drop(*[f"_r_{key}" for key in keys])


def with_hash_range(df: DataFrame, hex_key: str, ranges: int) -> DataFrame:
    """Range number of a uniform hex key: equal widths need no sample."""
    return df.withColumn(RANGE, F.expr(f"int({ranges} * bigint(conv(substring({hex_key}, 1, 8), 16, 10)) div {DRAW_RANGE})"))


def _with_hot_ranges(df: DataFrame, order: str, by: Sequence[str]) -> DataFrame | None:
    """Range numbers for the rows of oversized groups, 0 for all others; None if no group is oversized.

    An oversized group holds more than 1/10,000 of all rows, so there are under 10,000 of them and
    their keys can be broadcast.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    limit = max(ROWS_PER_RANGE, (total or 0) // MOST_HOT_GROUPS)
    if (largest or 0) <= limit:
        return None
    hot = sizes.where(F.col("_rows") > limit).select(*by, F.lit(True).alias("_hot"))
    # a null group finds no mark and stays in one range
    marked = df.join(F.broadcast(hot), list(by), "left")
    ranged = with_range(marked, order, range_cuts(df, order))
    return ranged.withColumn(RANGE, F.when(F.col("_hot"), F.col(RANGE)).otherwise(0)).drop("_hot")


def running_total(
    df: DataFrame,
    order: str,
    value: str,
    into: str,
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
    first: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over all earlier rows (exclusive) of the same ``by`` group.

    ``order`` must be unique within a group. ``first`` maps a new column to a source column whose
    value on the group's first row is to be carried to every row. Pass ``cuts`` to reuse known cut
    points; a frame that already carries a range column keeps it.
    """
    first = first or {}
    if RANGE in df.columns:
        ranged = df
    elif by:
        ranged = _with_hot_ranges(df, order, by)
    else:
        ranged = with_range(df, order, range_cuts(df, order) if cuts is None else cuts)
    if ranged is None:
        group = W.partitionBy(*by).orderBy(order)
        earlier = F.sum(value).over(group.rowsBetween(W.unboundedPreceding, -1))
        return df.withColumns(
            {into: F.coalesce(earlier, F.lit(0)), **{name: F.first(source).over(group) for name, source in first.items()}}
        )

    part = [*by, RANGE]
    totals = ranged.groupBy(*part).agg(
        F.sum(value).alias("_total"),
        *[F.min_by(source, order).alias(name) for name, source in first.items()],
    )
    group = W.partitionBy(*by).orderBy(RANGE)
    bases = totals.select(
        *part,
        F.coalesce(F.sum("_total").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        *[F.first(name).over(group).alias(name) for name in first],
    )
    if not by:
        # One row per range, and the number of ranges is set above: bounded, so safe to broadcast.
        bases = F.broadcast(bases)

    inside = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        _join_null_safe(local, bases, part)
        .withColumn(into, F.col("_base") + F.col("_local"))
        .drop("_base", "_local", RANGE)
    )


def running_rank(df: DataFrame, order: str, into: str, by: Sequence[str] = (), **more) -> DataFrame:
    """Add ``into``: the zero-based position of the row in its group."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", into, by, **more).drop("_one")


def hashed_rank(df: DataFrame, hex_key: str, into: str, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Zero-based position in the order of a uniform hex key, that is, in a random permutation."""
    ranged = with_hash_range(df, hex_key, _even_parts(df, rows))
    return running_rank(ranged, hex_key, into, by)
