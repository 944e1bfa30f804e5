"""Result files: JSON objects keyed by run, in the encodings found in practice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.results import TASKS

# The fields of a result record; any may be absent.
RECORD = "struct<model:string, step:bigint, phase:int, tokens:bigint, " + ", ".join(f"{t}:double" for t in TASKS) + ">"
SCORE = "struct<score:double, status:string>"


def _objects(spark: SparkSession, path: str, schema: str, whole_files: bool) -> DataFrame:
    """Key and value of every top-level entry: of each file, or of each line."""
    text = spark.read.text(path, wholetext=whole_files)
    parsed = text.select(F.from_json("value", f"map<string, {schema}>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "v"))


def read_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{run: {model, step, …, <task>: score}}`` to one row per run; absent fields are null."""
    return _objects(spark, path, RECORD, whole_files).select("key", "v.*")


def read_flat_scores(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{niah_L512_model: 0.5}``: no status is recorded."""
    rows = _objects(spark, path, "double", whole_files)
    return _keyed_scores(rows, r"^niah_L(\d+)_(.+)$", F.col("v"), F.lit(None).cast("string"))


def read_status_scores(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{L512_model: {score, status}}``."""
    rows = _objects(spark, path, SCORE, whole_files)
    return _keyed_scores(rows, r"^L(\d+)_(.+)$", F.col("v.score"), F.col("v.status"))


def read_nested_scores(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{L512: {model: {score, status}}}``."""
    rows = _objects(spark, path, f"map<string, {SCORE}>", whole_files)
    models = rows.select("key", F.explode("v").alias("model", "s"))
    return models.select(
        F.regexp_extract("key", r"^L(\d+)$", 1).cast("int").alias("context_len"),
        "model",
        F.col("s.score").alias("score"),
        F.col("s.status").alias("status"),
    )


def _keyed_scores(rows: DataFrame, pattern: str, score, status) -> DataFrame:
    return rows.where(F.col("key").rlike(pattern)).select(
        F.regexp_extract("key", pattern, 1).cast("int").alias("context_len"),
        F.regexp_extract("key", pattern, 2).alias("model"),
        score.alias("score"),
        status.alias("status"),
    )


def read_seed_scores(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{model: {scores: […], mean, std}}`` to ``(model, scores, mean, std)``."""
    schema = "struct<scores:array<double>, mean:double, std:double>"
    return _objects(spark, path, schema, whole_files).select(F.col("key").alias("model"), "v.*")


def read_layer_scales(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{layer: {raw: […], softplus: […], mean, std}}`` to ``(layer, values)``."""
    schema = "struct<raw:array<double>, softplus:array<double>, mean:double, std:double>"
    rows = _objects(spark, path, schema, whole_files)
    return rows.select(F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("layer"), F.col("v.raw").alias("values"))


def section(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One named section of a file of sections, as rows of JSON text (``value``)."""
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{name}").alias("value"))


def json_lines(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One object per row, ``{key: {fields}}``; null fields are left out.

    Each row is its own object, so nothing has to be brought together to write it.
    """
    return rows.select(F.to_json(F.create_map(F.col(key), F.struct(*fields))).alias("value"))


def write_results(rows: DataFrame, path: str, key: str = "key", fields: list[str] | None = None) -> None:
    fields = fields or [c for c in rows.columns if c != key]
    json_lines(rows, key, fields).write.text(path)


def write_task_results(rows: DataFrame, tag: str, path: str) -> None:
    """``(task, accuracy)`` as one object ``{tag: {task: accuracy}}``; there is one row per task."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "accuracy"))))
    rows.agg(F.to_json(F.create_map(F.lit(tag), entries)).alias("value")).write.text(path)


def read_task_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``{tag: {task: accuracy}}`` to ``(tag, task, score)``."""
    rows = _objects(spark, path, "map<string, double>", whole_files)
    return rows.select(F.col("key").alias("tag"), F.explode("v").alias("task", "score"))


def bench_metrics(task_results: DataFrame) -> DataFrame:
    """``(task, metrics map)`` to ``(metric, value)``: ``bench/<task>_acc``, tasks without accuracy left out."""
    from weftline.operators.scoring import preferred_metric

    named = task_results.select(
        F.concat(F.lit("bench/"), F.col("task"), F.lit("_acc")).alias("metric"), preferred_metric().alias("value")
    )
    return named.where(F.col("value").isNotNull())
