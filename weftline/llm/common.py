"""What the operators share: the rows' own key, the parallelism, and staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship_package, small_batches, stage

__all__ = ["ROW_KEY", "anti_join", "partitions", "ready", "row_key", "semi_join", "sized", "small_batches", "stage", "table"]

#: Name of the column that tells input rows apart; long and odd, so that it clashes with no column of the input.
ROW_KEY = "__row_key"


def ready(spark: SparkSession) -> SparkSession:
    """Workers get the package that the functions sent to them are loaded from."""
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A key from the row's own values: the same whenever a lost task is computed again, also for null ids."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that a join may send to every task.
BROADCAST_BYTES = 32_000_000


def sized(keys: DataFrame, key_bytes: int) -> DataFrame:
    """``keys``, to be sent to all tasks of a join if they are few; else the join shuffles."""
    few = keys.limit(BROADCAST_BYTES // key_bytes + 1).count() * key_bytes <= BROADCAST_BYTES
    return F.broadcast(keys) if few else keys


def semi_join(rows: DataFrame, keys: DataFrame, on: str, key_bytes: int = 8) -> DataFrame:
    """The rows whose ``on`` is among ``keys`` (distinct)."""
    return rows.join(sized(keys, key_bytes), on, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, on: str, key_bytes: int = 8) -> DataFrame:
    """The rows whose ``on`` is not among ``keys`` (distinct)."""
    return rows.join(sized(keys, key_bytes), on, "left_anti")
