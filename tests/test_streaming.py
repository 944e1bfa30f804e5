"""Streams in several micro-batches and restarts give what one batch gives."""

import shutil

from pyspark.sql import functions as F

from weftline.operators import corpus as C
from weftline.operators import packing as P
from weftline.plans import streams as Q
from weftline.sources import logs as L
from weftline.streaming import packing as SP
from weftline.streaming import pending as SN
from weftline.streaming import telemetry as ST

SCHEMA = "doc_id long, text string"


def documents(spark):
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i % 9)) for i in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def arrive(docs, folder, low, high):
    docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(2).write.mode("append").parquet(folder)


def blocks(frame):
    return sorted((r.block_id, r.tokens) for r in frame.collect())


def test_packing_across_micro_batches_and_restarts(spark, tmp_path):
    docs = documents(spark)
    encode = C.native_encoder(C.vocabulary(docs))
    whole = C.token_spans(C.encoded_corpus(docs, encode))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 1), (1, 3), (3, 40), (40, 60)):
        arrive(docs, folder, low, high)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        SP.start_packing(stream, encode, out, f"{out}/checkpoint", 6).awaitTermination()
    assert blocks(SP.packed_blocks(spark, out, 6)) == blocks(P.disjoint_blocks(whole, 6))
    # nothing new: a restart emits nothing
    SP.start_packing(spark.readStream.schema(SCHEMA).parquet(folder), encode, out, f"{out}/checkpoint", 6).awaitTermination()
    assert blocks(SP.packed_blocks(spark, out, 6)) == blocks(P.disjoint_blocks(whole, 6))


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    docs = documents(spark)
    encode = C.native_encoder(C.vocabulary(docs))
    out = str(tmp_path / "out")
    parts = [docs.where("doc_id < 20"), docs.where("doc_id >= 20 AND doc_id < 21"), docs.where("doc_id >= 21")]
    for i in (0, 1, 1, 2, 2):
        SP.pack_batch(parts[i], i, encode, out, 6)
    whole = C.token_spans(C.encoded_corpus(docs, encode))
    assert blocks(SP.packed_blocks(spark, out, 6)) == blocks(P.disjoint_blocks(whole, 6))


def test_budget_stops_the_stream(spark, tmp_path):
    docs = documents(spark)
    encode = C.native_encoder(C.vocabulary(docs))
    out = str(tmp_path / "out")
    for i in range(6):
        SP.pack_batch(docs.where(f"doc_id div 10 = {i}"), i, encode, out, 6, max_tokens=50)
    whole = C.token_spans(C.encoded_corpus(docs, encode))
    got = blocks(SP.packed_blocks(spark, out, 6))
    assert got == blocks(P.disjoint_blocks(whole, 6, 50)) and len(got) == 9
    written = spark.read.parquet(f"{out}/windows").select("batch").distinct().count()
    assert written < 6  # batches after the budget do no work


def test_a_running_query_ends_at_its_budget(spark, tmp_path):
    docs = documents(spark)
    encode = C.native_encoder(C.vocabulary(docs))
    whole = C.token_spans(C.encoded_corpus(docs, encode))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(docs, folder, 0, 3)

    def run(**trigger):
        return SP.pack_to_budget(spark.readStream.schema(SCHEMA).parquet(folder), encode, out, f"{out}/checkpoint", 6, 50, **trigger)

    assert not run()  # the stream ends first
    arrive(docs, folder, 3, 60)
    assert run(processingTime="1 second")  # it would go on for ever
    assert blocks(SP.packed_blocks(spark, out, 6)) == blocks(P.disjoint_blocks(whole, 6, 50))
    assert run(processingTime="1 second")  # nothing new arrives, and nothing is waited for
    arrive(docs, folder, 0, 60)
    assert run(processingTime="1 second")
    assert blocks(SP.packed_blocks(spark, out, 6)) == blocks(P.disjoint_blocks(whole, 6, 50))


def test_metrics_are_emitted_once(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    line = "  step {:>6d}/100 | loss 1.5000 | ppl 4.5 | grad 0.100 | lr 1.00e-03 | tok/s 100\n"
    for part, steps in (("a", range(5, 35, 5)), ("b", range(35, 65, 5))):
        (logs / f"{part}.log").write_text("header\n" + "".join(line.format(s) for s in steps))
        stream = L.stream_training_logs(spark, str(logs)).withColumn("run", F.lit("r"))
        ST.emit_metrics(stream, out, str(tmp_path / "cp"), 10).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.step for r in rows) == [10, 20, 30, 40, 50, 60] and {r.run for r in rows} == {"r"}


def test_throughput_state_survives_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run string, restart int, at long, tokens long"
    for rows in ([("r", 0, 0, 10), ("s", 0, 0, 1)], [("r", 0, 2_000_000, 30)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        ST.latest_throughput(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.run: (r.tokens, r.tokens_per_second) for r in ST.current_throughput(spark, out).collect()}
    assert got == {"r": (40, 20.0), "s": (1, 1e6)}
    batch = {r.run: r.tokens for r in ST.running_throughput(spark.read.schema(schema).parquet(folder)).collect()}
    assert batch == {"r": 40, "s": 1}


def test_new_logs_shorten_the_plan(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    available = spark.createDataFrame([("a",), ("b",)], "tag string")
    left = []
    for name, text in (("1", "===== a =====\n  niah: 0.5\n"), ("2", "===== a =====\n  lambada: 0.5\n\n===== b =====\n  niah: 1.0\n")):
        (logs / f"{name}.log").write_text(text)
        reports = L.stream_bench_logs(spark, str(logs)).select("tag", "task")
        SN.stream_finished(reports, out, str(tmp_path / "cp")).awaitTermination()
        rows = SN.remaining_plan(plan, SN.collected(spark, out), available, "tag", ["niah", "lambada"])
        left.append({(r.tag, r.state) for r in rows.collect()})
    assert left[0] == {("a", "runnable"), ("b", "runnable"), ("c", "missing")}
    assert left[1] == {("b", "runnable"), ("c", "missing")}


def test_tables_of_one_file_and_of_many_are_streamed(spark, tmp_path):
    docs = documents(spark)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(5).write.parquet(f"{tmp_path}/documents.parquet.old")
    assert Q.stream_pack(spark, str(tmp_path)).count() == 0  # fewer tokens than a block
    [part] = [p for p in (tmp_path / "documents.parquet.old").iterdir() if p.suffix == ".parquet"]
    (tmp_path / "one").mkdir()
    shutil.copy(part, tmp_path / "one" / "documents.parquet")
    for folder, rows in ((tmp_path, 60), (tmp_path / "one", 5)):
        seen = []
        stream = Q.stream_of(spark, str(folder), "documents").writeStream.foreachBatch(lambda batch, _, seen=seen: seen.append(batch.count()))
        stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert sum(seen) == rows
