"""Packing a document stream into blocks, with the leftover tokens carried between micro-batches.

The stream is one sequence: documents follow each other in arrival order (by ``doc_id`` inside a
micro-batch), and blocks are cut across document and micro-batch borders. A keyed state store would
put that whole sequence in one task. Here a micro-batch is packed as a distributed job, and only the
carry — the next block number and fewer tokens than one block — passes to the next one.

Exactly once: outputs and carries are written per batch id and overwritten when a batch is replayed
after a failure; a batch starts from the latest carry before its own id.

A token budget counts what was produced by blocks, so it needs no state beside the carry: the batch that reaches it
produces up to it, batches after it nothing, and ``pack_to_budget`` then ends the query.
"""

from __future__ import annotations

from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.corpus import Encoder, encoded_corpus, token_spans
from weftline.operators.packing import windows
from weftline.session import spread

CARRY_SCHEMA = "batch long, next_block long, ids array<int>"


def _latest_carry(spark: SparkSession, path: str, before: int) -> tuple[int, DataFrame]:
    """Next block number, and the carried tokens as a one-row span."""
    empty = "doc_id long, n_tokens long, ids array<int>, start long"
    if before == 0:
        return 0, spark.createDataFrame([], empty)
    carries = spark.read.schema(CARRY_SCHEMA).option("basePath", path).parquet(path).where(F.col("batch") < before)
    latest = carries.orderBy(F.desc("batch")).limit(1)
    row = latest.select("next_block").first()
    span = latest.select(
        F.lit(-1).cast("bigint").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.lit(0).cast("bigint").alias("start"),
    )
    return (row["next_block"] if row else 0), span


def pack_batch(
    documents: DataFrame, batch_id: int, encode: Encoder, out: str, seq_len: int, max_tokens: int | None = None
) -> bool:
    """Pack one micro-batch after what earlier batches left over; says whether the budget is used up."""
    spark = documents.sparkSession
    length = seq_len + 1
    next_block, carried = _latest_carry(spark, f"{out}/carry", batch_id)
    limit = -(-max_tokens // seq_len) if max_tokens else None
    if limit is not None and next_block >= limit:
        return True  # nothing more is produced
    held = carried.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]

    spans = token_spans(encoded_corpus(spread(documents, "doc_id"), encode)).withColumn("start", F.col("start") + held)
    packed = windows(spans.unionByName(carried), length, length)
    numbered = packed.withColumn("block_id", F.col("block_id") + next_block)
    if limit is not None:
        numbered = numbered.where(F.col("block_id") < limit)
    target = f"{out}/windows/batch={batch_id}"
    numbered.write.mode("overwrite").parquet(target)

    # The one window that did not fill up is what the next batch starts with.
    written = spark.read.schema("block_id long, tokens array<int>").parquet(target)
    whole = F.size("tokens") == length
    carry = written.agg(
        F.lit(batch_id).cast("bigint").alias("batch"),
        (F.lit(next_block) + F.count_if(whole)).alias("next_block"),
        F.coalesce(F.first(F.when(~whole, F.col("tokens")), ignorenulls=True), F.array().cast("array<int>")).alias("ids"),
    )
    kept = f"{out}/carry/batch={batch_id}"
    carry.coalesce(1).drop("batch").write.mode("overwrite").parquet(kept)
    return limit is not None and spark.read.parquet(kept).first()["next_block"] >= limit


def start_packing(
    documents: DataFrame,
    encode: Encoder,
    out: str,
    checkpoint: str,
    seq_len: int,
    max_tokens: int | None = None,
    used_up: Event | None = None,
    **trigger,
) -> StreamingQuery:
    """Pack a streaming frame of documents; ``checkpoint`` lets a restarted query go on where it was.

    ``used_up`` is set once ``max_tokens`` are produced.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if pack_batch(batch, batch_id, encode, out, seq_len, max_tokens) and used_up:
            used_up.set()

    writer = documents.select("doc_id", "text").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def pack_to_budget(
    documents: DataFrame, encode: Encoder, out: str, checkpoint: str, seq_len: int, max_tokens: int, **trigger
) -> bool:
    """Pack until ``max_tokens`` are produced or the stream ends, then stop the query; says whether they are.

    A batch that the stop cuts short is replayed by a restarted query and then finds the budget used up.
    """
    used_up = Event()
    try:
        produced = _latest_carry(documents.sparkSession, f"{out}/carry", 1 << 62)[0] * seq_len
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        produced = 0
    if produced >= max_tokens:
        return True
    query = start_packing(documents, encode, out, checkpoint, seq_len, max_tokens, used_up, **trigger)
    while not query.awaitTermination(1):
        if used_up.is_set():
            query.stop()
    return used_up.is_set()


def packed_blocks(spark: SparkSession, out: str, seq_len: int) -> DataFrame:
    """``(block_id, tokens)`` of the whole blocks so far."""
    found = spark.read.schema("block_id long, tokens array<int>, batch long").option("basePath", f"{out}/windows").parquet(f"{out}/windows")
    return found.select("block_id", "tokens").where(F.size("tokens") == seq_len + 1)
