"""The streaming jobs, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import corpus as C
from weftline.operators.prefix import RANGE, range_cuts, with_range
from weftline.operators.results import TASKS
from weftline.plans import corpus as CP
from weftline.plans import telemetry as TP
from weftline.plans.corpus import describe_blocks, documents
from weftline.plans.reports import as_answers
from weftline.plans.tables import SEQ_LEN, table
from weftline.session import fresh_path
from weftline.streaming import packing as P
from weftline.streaming import pending as N
from weftline.streaming import telemetry as T


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files: a stream may start at neither name, but at a pattern of it."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _encoder(docs: DataFrame) -> C.Encoder:
    return C.native_encoder(C.vocabulary(docs))


def stream_pack(spark, sf_dir):
    out = fresh_path(spark, "stream-pack")
    encode = _encoder(documents(spark, sf_dir))
    query = P.start_packing(stream_of(spark, sf_dir, "documents"), encode, out, f"{out}/checkpoint", SEQ_LEN)
    query.awaitTermination()
    return describe_blocks(P.packed_blocks(spark, out, SEQ_LEN))


def stream_pack_resumed(spark, sf_dir):
    """Documents arrive in three portions; the query is stopped and started anew for each."""
    docs = documents(spark, sf_dir)
    encode = _encoder(docs)
    out = fresh_path(spark, "stream-pack")
    portions = with_range(docs, "doc_id", range_cuts(docs, "doc_id", 3))
    arriving = f"{out}/arriving"
    for portion in range(3):
        portions.where(F.col(RANGE) == portion).drop(RANGE).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(docs.schema).parquet(arriving)
        P.start_packing(stream, encode, out, f"{out}/checkpoint", SEQ_LEN).awaitTermination()
    return describe_blocks(P.packed_blocks(spark, out, SEQ_LEN))


def stream_pack_budget(spark, sf_dir):
    """Half of all tokens are asked for; documents arrive in three portions, so the second one crosses the budget."""
    docs = documents(spark, sf_dir)
    counts = C.token_counts(docs)
    vocab = C.vocabulary_of(counts)
    encode = C.native_encoder(vocab)
    budget = C.native_total(docs, counts, vocab) // 2
    out = fresh_path(spark, "stream-pack")
    portions = with_range(docs, "doc_id", range_cuts(docs, "doc_id", 3))
    arriving = f"{out}/arriving"
    for portion in range(3):
        portions.where(F.col(RANGE) == portion).drop(RANGE).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(docs.schema).parquet(arriving)
        if P.pack_to_budget(stream, encode, out, f"{out}/checkpoint", SEQ_LEN, budget):
            break
    return describe_blocks(P.packed_blocks(spark, out, SEQ_LEN))


def stream_metrics(spark, sf_dir):
    """Running throughput of every run after the whole event stream."""
    out = fresh_path(spark, "stream-metrics")
    rows = TP.as_token_rows(stream_of(spark, sf_dir, "events"))
    T.latest_throughput(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return T.current_throughput(spark, f"{out}/rows").select(
        "run", "restart", "tokens", F.round("seconds", 6).alias("seconds"), F.round("tokens_per_second", 4).alias("tokens_per_second")
    )


def stream_emit(spark, sf_dir):
    """Every tenth event as a logged step, appended by run."""
    out = fresh_path(spark, "stream-emit")
    steps = stream_of(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")
    )
    T.emit_metrics(steps, f"{out}/rows", f"{out}/checkpoint", 10).awaitTermination()
    return spark.read.schema("step long, loss double, run long").parquet(f"{out}/rows").select("run", "step", "loss")


def stream_pending(spark, sf_dir):
    """Model-and-user pairs for which the streamed reports do not cover all five tasks; purchases have their input."""
    out = fresh_path(spark, "stream-pending")
    tag = F.concat_ws("_", "model", F.col("user_id").cast("string")).alias("tag")
    rows = as_answers(table(spark, sf_dir, "events"))
    reports = as_answers(stream_of(spark, sf_dir, "events")).select(tag, "task")
    N.stream_finished(reports, f"{out}/reports", f"{out}/checkpoint").awaitTermination()
    plan = rows.select(tag).distinct()
    available = rows.where("model = 'purchase'").select(tag).distinct()
    return N.remaining_plan(plan, N.collected(spark, f"{out}/reports"), available, "tag", TASKS)


QUERIES = {
    "stream_pack": stream_pack,
    "stream_pack_resumed": stream_pack_resumed,
    "stream_pack_budget": stream_pack_budget,
    "stream_metrics": stream_metrics,
    "stream_emit": stream_emit,
    "stream_pending": stream_pending,
}

SQL = {
    "stream_pack": CP.SQL["pack_blocks_streaming"],
    "stream_pack_resumed": CP.SQL["pack_blocks_streaming"],
    "stream_pack_budget": CP.streaming_blocks_sql(f"least(t // {SEQ_LEN + 1}, (t // 2 + {SEQ_LEN - 1}) // {SEQ_LEN})"),
    "stream_metrics": f"""WITH {TP._TOKENS_SQL}
SELECT run, restart, sum(tokens)::BIGINT AS tokens, round((max(at_us) - min(at_us)) / 1e6, 6) AS seconds,
       round(sum(tokens) / greatest((max(at_us) - min(at_us)) / 1e6, 1e-6), 4) AS tokens_per_second
FROM t GROUP BY ALL""",
    "stream_emit": "SELECT user_id % 8 AS run, event_id AS step, value AS loss FROM events WHERE event_id % 10 = 0",
    "stream_pending": """
WITH tags AS (SELECT event_type || '_' || user_id AS tag, event_type, json_extract_string(props, '$.k')::BIGINT % 5 AS task FROM events)
SELECT tag, CASE WHEN any_value(event_type) = 'purchase' THEN 'runnable' ELSE 'missing' END AS state
FROM tags GROUP BY tag HAVING count(DISTINCT task) < 5""",
}
