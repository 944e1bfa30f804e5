"""Document corpora and benchmark items, with explicit schemas: no pass is spent on inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENT = "doc_id bigint, text string"

# The fields of each benchmark's items.
ITEMS = {
    "lambada": "item_id bigint, text string",
    "hellaswag": "item_id bigint, ctx string, endings array<string>, label string",
    "arc_easy": "item_id bigint, question string, choices struct<text: array<string>>, answerKey string",
    "winogrande": "item_id bigint, sentence string, option1 string, option2 string, answer string",
}


def read_documents(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """``(doc_id, text)``; other fields of the source are not read, an absent text is null."""
    return spark.read.schema(DOCUMENT).format(format).load(path)


def stream_documents(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1_000) -> DataFrame:
    """The same rows from a folder that keeps growing."""
    return spark.readStream.schema(DOCUMENT).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


def read_items(spark: SparkSession, task: str, path: str, format: str = "json") -> DataFrame:
    """Items of one benchmark, as the task runners take them."""
    if task not in ITEMS:
        raise ValueError(f"no item schema for {task}; known: {sorted(ITEMS)}")
    return spark.read.schema(ITEMS[task]).format(format).load(path)
