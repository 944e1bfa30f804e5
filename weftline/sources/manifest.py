"""The manifest beside the shards: seven ``key=value`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "meta.txt"
# The keys in file order.
KEYS = ("total_tokens", "num_shards", "vocab_size", "eos_id", "dtype", "dataset", "tokenizer")
NUMBERS = KEYS[:4]


def manifest_text(total_tokens: int, num_shards: int, **facts: object) -> str:
    values = {"total_tokens": total_tokens, "num_shards": num_shards, "dtype": "uint16", **facts}
    return "".join(f"{key}={values[key]}\n" for key in KEYS if key in values)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One typed row; keys missing from the file are null."""
    parsed = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).select(
        F.expr(r"str_to_map(trim(value), '\n', '=')").alias("m")
    )
    return parsed.select(
        *[F.try_element_at("m", F.lit(k)).cast("bigint" if k in NUMBERS else "string").alias(k) for k in KEYS]
    )


def write_manifest(row: DataFrame, folder: str) -> None:
    """Write a one-row frame as ``key=value`` lines where :func:`read_manifest` looks for them."""
    lines = [F.concat(F.lit(f"{key}="), F.col(key).cast("string")) for key in KEYS if key in row.columns]
    row.select(F.concat_ws("\n", *lines).alias("value")).coalesce(1).write.text(f"{folder}/{MANIFEST}")


def has_manifest(folder: str) -> bool:
    from pyarrow import fs as pafs

    from weftline.sources.token_shards import open_folder

    files, root = open_folder(folder)
    return files.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound


def open_training_source(spark: SparkSession, folder: str, documents: str) -> tuple[str, DataFrame]:
    """Shards where a manifest says they exist, otherwise the documents as a stream."""
    if has_manifest(folder):
        from weftline.sources.token_shards import read_shards

        return "shards", read_shards(spark, folder)
    schema = spark.read.parquet(documents).schema
    return "documents", spark.readStream.schema(schema).parquet(documents)
