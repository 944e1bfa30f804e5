"""Benchmark logs and training logs: rendered lines to rows, and rows to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The line formats.
BENCH_BREAK = "\n====="
BENCH_TAG = r"^(?:=====)?\s*(.+?) =====[ \t]*(?:\n|$)"
BENCH_LINE = r"(?m)^\s+([a-z0-9_]+): ([0-9.]+)(?:\s+\((\d+)s\))?[ \t]*$"
STEP_BREAK = "\n  step "
STEP_LINE = r"^\s*(?:step)?\s*(\d+)/(\d+) \| loss (\S+) \| ppl (\S+) \| grad (\S+) \| lr (\S+) \| tok/s (\S+)"
VALIDATION_LINE = r">>> val_loss=(\S+)\s+val_ppl=(\S+)"


def _records(reader, path: str, separator: str) -> DataFrame:
    """A log cut at ``separator`` instead of at each line: a record is a header with all that follows it.

    Files still split into byte ranges, and no order among lines has to be restored.
    """
    return reader.option("lineSep", separator).text(path).select(F.input_file_name().alias("file"), "value")


def parse_bench_records(records: DataFrame) -> DataFrame:
    """``(file, value)`` to ``(file, tag, task, score, seconds)``."""
    tagged = records.select("file", F.regexp_extract("value", BENCH_TAG, 1).alias("tag"), "value").where("tag <> ''")
    lines = tagged.select("file", "tag", F.explode(F.regexp_extract_all("value", F.lit(BENCH_LINE), F.lit(0))).alias("line"))
    seconds = F.regexp_extract("line", BENCH_LINE, 3)
    return lines.select(
        "file",
        "tag",
        F.regexp_extract("line", BENCH_LINE, 1).alias("task"),
        F.regexp_extract("line", BENCH_LINE, 2).cast("double").alias("score"),
        F.when(seconds != "", seconds).cast("bigint").alias("seconds"),
    )


def read_bench_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_bench_records(_records(spark.read, path, BENCH_BREAK))


def stream_bench_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_bench_records(_records(spark.readStream, path, BENCH_BREAK))


def parse_step_records(records: DataFrame) -> DataFrame:
    """``(file, value)`` to one row per logged step, with the validation line that follows it, if any."""
    return records.where(F.col("value").rlike(STEP_LINE)).select("file", *step_columns("value"))


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_step_records(_records(spark.read, path, STEP_BREAK))


def stream_training_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_step_records(_records(spark.readStream, path, STEP_BREAK))


def step_columns(text: str):
    """Columns of a logged step; numbers that do not parse are null."""

    def field(pattern, i, kind):
        found = F.regexp_extract(text, pattern, i)
        return F.when(found != "", found).try_cast(kind)

    names = ["step", "total_steps", "loss", "ppl", "grad_norm", "lr", "tokens_per_second"]
    kinds = ["bigint", "bigint"] + ["double"] * 5
    columns = [field(STEP_LINE, i + 1, kind).alias(name) for i, (name, kind) in enumerate(zip(names, kinds))]
    return [
        *columns,
        field(VALIDATION_LINE, 1, "double").alias("val_loss"),
        field(VALIDATION_LINE, 2, "double").alias("val_ppl"),
    ]


def render_bench_log(tag, tasks) -> object:
    """Column of a whole log: header, then one line per ``(task, score, seconds)`` of the array ``tasks``."""
    line = F.transform(
        tasks, lambda t: F.format_string("  %s: %.4f  (%ds)", t["task"], t["score"], t["seconds"])
    )
    return F.concat(F.lit("\n===== "), tag, F.lit(" =====\n"), F.array_join(line, "\n"), F.lit("\n"))


def render_step_line(step, total_steps, loss, ppl, grad_norm, lr, tokens_per_second) -> object:
    pattern = "  step %6d/%d | loss %.4f | ppl %.1f | grad %.3f | lr %.2e | tok/s %.0f"
    return F.format_string(pattern, step, total_steps, loss, ppl, grad_norm, lr, tokens_per_second)
