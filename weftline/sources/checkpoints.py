"""Checkpoint folders as a manifest: paths and sizes only, contents are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import zero_padded

# How checkpoint folders and files are named.
FOLDER = r"phase(\d+)_([^/]+)/[^/]+$"
STEP_FILE = r"/step_(\d+)\.pt$"
FINAL_FILE = r"/final\.pt$"


def checkpoint_columns(path: Column) -> list[Column]:
    step = F.regexp_extract(path, STEP_FILE, 1)
    return [
        F.regexp_extract(path, FOLDER, 1).try_cast("int").alias("phase"),
        F.regexp_extract(path, FOLDER, 2).alias("model"),
        F.when(step != "", step).try_cast("bigint").alias("step"),
        path.rlike(FINAL_FILE).alias("is_final"),
    ]


def parse_checkpoints(paths: DataFrame) -> DataFrame:
    """``path`` to ``(phase, model, step, is_final, path)``; files of other names are left out."""
    named = paths.where(F.col("path").rlike(FOLDER) & (F.col("path").rlike(STEP_FILE) | F.col("path").rlike(FINAL_FILE)))
    return named.select(*checkpoint_columns(F.col("path")), *paths.columns)


def read_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """All checkpoint files below ``root``. The content column is not selected, so no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pt").load(root)
    return parse_checkpoints(listed.select("path", "length", "modificationTime"))


def checkpoint_path(phase: Column, model: Column, step: Column) -> Column:
    return F.concat(
        F.lit("phase"), phase.cast("string"), F.lit("_"), model, F.lit("/step_"), zero_padded(step, 6), F.lit(".pt")
    )
