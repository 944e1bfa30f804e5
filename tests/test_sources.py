"""Shards, manifests, result files, logs and checkpoints: written, read back, and hand-made."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus as C
from weftline.operators import packing as P
from weftline.operators import pending as N
from weftline.operators import results as R
from weftline.operators import shards as S
from weftline.sources import checkpoints as CK
from weftline.sources import items as I
from weftline.sources import logs as L
from weftline.sources import manifest as M
from weftline.sources import results as J
from weftline.operators import batches as B
from weftline.sources import token_shards as K

FACTS = {"vocab_size": 65536, "eos_id": 0, "dataset": "d", "tokenizer": "t"}


def spans_of(spark, sizes, first=0):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, n, [(first + at + k) % 65536 for k in range(n)]))
        at += n
    return C.token_spans(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>").repartition(3))


def test_shards_round_trip(spark, tmp_path):
    path = str(tmp_path / "shards")
    K.write_shards(S.shard_pieces(spans_of(spark, [900, 1, 700, 750], 65000), 1000), path, **FACTS)
    now = K.version_folder(path)
    assert sorted(os.listdir(path)) == ["meta.txt", os.path.basename(now)]
    assert sorted(os.listdir(now)) == ["meta.txt", "shard_0000.bin", "shard_0001.bin", "shard_0002.bin"]
    assert os.path.getsize(f"{now}/shard_0002.bin") == 2 * 351
    flat = np.concatenate([np.fromfile(f"{now}/shard_{i:04d}.bin", "<u2") for i in range(3)])
    assert flat.tolist() == [(65000 + k) % 65536 for k in range(2351)]
    rows = K.read_shards(spark, path)
    assert rows.count() == 2351
    assert rows.where((F.col("pos") + 65000) % 65536 != F.col("token")).count() == 0

    facts = M.read_manifest(spark, path).first().asDict()
    assert facts == {"total_tokens": 2351, "num_shards": 3, "dtype": "uint16", **FACTS}
    assert open(f"{path}/meta.txt").read().splitlines()[0] == "total_tokens=2351"


def test_range_reads_touch_only_their_bytes(spark, tmp_path):
    path = str(tmp_path / "shards")
    K.write_shards(S.shard_pieces(spans_of(spark, [5000]), 1000), path, **FACTS)
    got = K.read_shards(spark, path, 990, 1020).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(990, 2010)) == [r.token for r in got]
    reader = K.ShardReader({"path": path, "start": "990", "length": "1020", "tokens_per_task": "500"})
    parts = reader.partitions()
    assert sum(p.count for p in parts) == 1020 and len(parts) == 3
    assert sum(n for p in parts for _, _, n in p.pieces) == 1020
    assert K.read_shards(spark, path, 4990, 100).count() == 10


@pytest.mark.parametrize("seq_len, cap", [(7, None), (128, None), (128, 2000), (6000, None)])
def test_blocks_from_shards_equal_packing(spark, tmp_path, seq_len, cap):
    path = str(tmp_path / "shards")
    spans = spans_of(spark, [900, 1, 700, 750])
    K.write_shards(S.shard_pieces(spans, 1000), path, **FACTS)
    K.register(spark)
    reader = spark.read.format(K.FORMAT).option("seq_len", seq_len).option("tokens_per_task", 300)
    served = reader.option("max_tokens", cap or 0).load(path)
    packed = P.overlapping_blocks(spans, seq_len, cap)
    as_rows = lambda df: sorted((r.block_id, r.tokens) for r in df.collect())
    assert as_rows(served) == as_rows(packed)


def test_existing_shards_are_kept_unless_overwritten(spark, tmp_path):
    path = str(tmp_path / "shards")
    K.write_shards(S.shard_pieces(spans_of(spark, [30]), 10), path, **FACTS)
    with pytest.raises(Exception, match="already holds shards"):
        K.write_shards(S.shard_pieces(spans_of(spark, [5]), 10), path, **FACTS)
    assert K.read_shards(spark, path).count() == 30
    K.write_shards(S.shard_pieces(spans_of(spark, [5]), 10), path, overwrite=True, **FACTS)
    assert K.read_shards(spark, path).count() == 5
    assert not [f for f in os.listdir(path) if f.startswith("_job")]


def test_a_commit_broken_at_any_step_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    K.write_shards(S.shard_pieces(spans_of(spark, [30]), 10), path, **FACTS)
    old = K.version_folder(path)

    def written():
        """A writer whose tasks have ended, and their messages."""
        writer = K.ShardWriter({"path": path, **FACTS}, overwrite=True)
        rows = [(k, 10 * k, list(range(100 + 10 * k, 110 + 10 * k))) for k in range(2)]
        batch = pa.table(dict(zip(("shard_id", "lo", "piece"), map(list, zip(*rows, strict=True)), strict=True))).to_batches()
        return writer, [writer.write(iter(batch))]

    steps = [0]

    def broken(real, at):
        def call(*args, **more):
            steps[0] += 1
            if steps[0] == at:
                raise OSError("gone")
            return real(*args, **more)

        return call

    class Files:
        """A file system that fails at its n-th change."""

        def __init__(self, real, at):
            self.real, self.at, self.type_name = real, at, real.type_name

        def __getattr__(self, name):
            real = getattr(self.real, name)
            return broken(real, self.at) if name in ("move", "create_dir", "delete_dir", "open_output_stream") else real

    for at in range(1, 9):
        writer, messages = written()
        real = K.open_folder
        steps[0] = 0
        with monkeypatch.context() as m:
            m.setattr(K, "open_folder", lambda p, at=at: (Files(real(p)[0], at), real(p)[1]))
            m.setattr(K, "MOVES", 1)
            try:
                writer.commit(messages)
                failed = False
            except OSError:
                failed = True
        now = K.version_folder(path)
        tokens = sorted(r.token for r in K.read_shards(spark, path).collect())
        if now == old:
            assert failed and tokens == list(range(30))
        else:  # it broke while clearing up, after the switch
            assert tokens == list(range(100, 120)) and at > 5
            K.write_shards(S.shard_pieces(spans_of(spark, [30]), 10), path, overwrite=True, **FACTS)
            old = K.version_folder(path)
    K.write_shards(S.shard_pieces(spans_of(spark, [7]), 10), path, overwrite=True, **FACTS)
    assert K.read_shards(spark, path).count() == 7
    assert len([f for f in os.listdir(path) if f.startswith("version-")]) == 2  # the one before stays for its readers


def test_published_shards_without_versions_are_read_and_replaced(spark, tmp_path):
    np.arange(50, dtype="<u2").tofile(tmp_path / "shard_0000.bin")
    (tmp_path / "meta.txt").write_text("total_tokens=50\nnum_shards=1\n")
    assert K.read_shards(spark, str(tmp_path)).count() == 50
    K.write_shards(S.shard_pieces(spans_of(spark, [7]), 10), str(tmp_path), overwrite=True, **FACTS)
    assert K.read_shards(spark, str(tmp_path)).count() == 7


def test_filters_on_positions_reach_the_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    K.write_shards(S.shard_pieces(spans_of(spark, [5000]), 1000), path, **FACTS)
    rows = lambda: K.read_shards(spark, path)
    for where, want in [
        ("pos >= 990 AND pos < 2010", range(990, 2010)), ("pos > 4990", range(4991, 5000)), ("pos = 17", [17]), ("pos <= 3 AND token <> 2", [0, 1, 3]),
        ("pos < 5 AND pos > 7", []), ("pos >= 2500 AND pos <= 2500", [2500]), ("pos IN (3, 4)", [3, 4]), ("pos > 9000", []),
    ]:
        assert sorted(r.token for r in rows().where(where).collect()) == list(want), where
    narrow = rows().where("pos >= 1500 AND pos < 2500")
    assert narrow.rdd.getNumPartitions() == 1
    reader = K.ShardReader({"path": path, "tokens_per_task": "1000"})
    left = list(reader.pushFilters([K.GreaterThanOrEqual(("pos",), 1500), K.LessThan(("pos",), 2500), K.EqualTo(("token",), 3)]))
    assert left == [K.EqualTo(("token",), 3)]
    files = {os.path.basename(file) for p in reader.partitions() for file, _, _ in p.pieces}
    assert files == {"shard_0001.bin", "shard_0002.bin"} and len(reader.partitions()) == 1


def test_training_batches_with_tokens(spark, tmp_path):
    path = str(tmp_path / "shards")
    spans = spans_of(spark, [900, 1, 700, 750])
    K.write_shards(S.shard_pieces(spans, 500), path, **FACTS)
    blocks = K.read_shard_blocks(spark, path, 64)
    n = P.num_overlapping_blocks(2351, 64)
    labelled = B.training_batches(blocks, n, 4, 3, 11)
    assert "Exchange" not in labelled._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: [(r.epoch, r.batch_id, r.slot, r.block_id, r.input_ids, r.labels) for r in df.collect()]
    served = rows(K.read_training_batches(spark, path, 64, 4, 3, 11, tokens_per_task=600))
    assert served == sorted(rows(labelled)) and len(served) == 3 * (n // 4 * 4)
    for epoch, _, _, block, ids, labels in served:
        assert ids == [(block * 64 + k) % 65536 for k in range(64)] and labels == [x + 1 for x in ids]
    orders = [[r[3] for r in served if r[0] == e] for e in range(3)]
    assert len({tuple(o) for o in orders}) == 3 and all(len(set(o)) == len(o) for o in orders)
    assert K.read_training_batches(spark, path, 64, 100, 1, 11).count() == 0


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [70_000])], "shard_id long, lo long, piece array<int>")
    with pytest.raises(Exception, match="16 bits"):
        K.write_shards(rows, str(tmp_path / "shards"), **FACTS)


def test_shards_are_ordered_by_number(tmp_path):
    for n in (2, 10000, 9999):
        np.array([n], "<u2").tofile(tmp_path / f"shard_{n:04d}.bin")
    assert [s[0] for s in K.list_shards(str(tmp_path))] == [2, 9999, 10000]
    assert [s[0] for s in K.list_shards(f"file://{tmp_path}")] == [2, 9999, 10000]
    with pytest.raises(FileNotFoundError):
        K.ShardReader({"path": str(tmp_path.parent)}).partitions()


def test_source_selection(spark, tmp_path):
    docs, shards = str(tmp_path / "docs"), str(tmp_path / "shards")
    os.makedirs(shards)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(docs)
    kind, frame = M.open_training_source(spark, shards, docs)
    assert kind == "documents" and frame.isStreaming
    K.write_shards(S.shard_pieces(spans_of(spark, [30]), 10), shards, **FACTS)
    kind, frame = M.open_training_source(spark, shards, docs)
    assert kind == "shards" and frame.count() == 30


def test_manifest_sink(spark, tmp_path):
    sizes = spark.createDataFrame([(0, 10), (1, 5)], "shard_id long, n_tokens long")
    M.write_manifest(S.manifest_row(sizes, **FACTS), str(tmp_path))
    assert M.has_manifest(str(tmp_path))
    assert M.read_manifest(spark, str(tmp_path)).first().asDict() == {"total_tokens": 15, "num_shards": 2, "dtype": "uint16", **FACTS}


def write_json(tmp_path, name, content):
    (tmp_path / name).write_text(json.dumps(content, indent=2))
    return str(tmp_path / name)


def test_pretty_printed_result_files(spark, tmp_path):
    path = write_json(tmp_path, "r.json", {
        "p2_m_a_step1000": {"model": "m_a", "step": 1000, "phase": 2, "tokens": 5, "lambada": 0.5, "niah": 1.0},
        "m_step20": {"model": "m", "step": 20, "lambada": 0.25},
    })
    rows = R.parse_run_keys(J.read_results(spark, path, whole_files=True).drop("model", "step", "phase"))
    got = {r.key: (r.phase, r.model, r.step, r.tokens, r.lambada, r.niah) for r in rows.collect()}
    assert got == {"p2_m_a_step1000": (2, "m_a", 1000, 5, 0.5, 1.0), "m_step20": (None, "m", 20, None, 0.25, None)}
    filled = R.fill_tokens(rows).where("model = 'm'").first().tokens
    assert filled == 20 * 524288
    own = R.fill_tokens(rows.withColumn("batch", F.lit(540672)), F.col("batch")).where("model = 'm'").first().tokens
    assert own == 20 * 540672


def test_score_encodings(spark, tmp_path):
    flat = write_json(tmp_path, "a.json", {"niah_L512_x": 1.0, "niah_L1024_x": 0.5, "other": 3.0})
    status = write_json(tmp_path, "b.json", {"L256_x": {"score": 0.9, "status": "OK"}})
    nested = write_json(tmp_path, "c.json", {"L256": {"x": {"score": 0.1, "status": "OK"}, "y": {"score": 0.2, "status": "OOM"}}})
    rows = [
        *J.read_flat_scores(spark, flat, True).collect(),
        *J.read_status_scores(spark, status, True).collect(),
        *J.read_nested_scores(spark, nested, True).collect(),
    ]
    assert {tuple(r) for r in rows} == {
        (512, "x", 1.0, None), (1024, "x", 0.5, None), (256, "x", 0.9, "OK"), (256, "x", 0.1, "OK"), (256, "y", 0.2, "OOM"),
    }


def test_seed_and_layer_sections(spark, tmp_path):
    content = {
        "seeds": {"a": {"scores": [1.0, 0.995, 1.0, 1.0, 1.0], "mean": 0.999, "std": 0.002}},
        "layers": {"layer_0": {"raw": [-1.0, -1.0], "softplus": [0.3, 0.3], "mean": 0.3, "std": 3e-8}},
    }
    path = write_json(tmp_path, "all.json", content)
    for name in ("seeds", "layers"):
        J.section(spark, path, name).write.text(str(tmp_path / name))
    seeds = J.read_seed_scores(spark, str(tmp_path / "seeds"))
    row = R.seed_summary(seeds).first()
    assert abs(row["mean"] - 0.999) < 1e-12 and abs(row["std"] - 0.002) < 1e-12
    layers = J.read_layer_scales(spark, str(tmp_path / "layers")).first()
    assert (layers.layer, layers["values"]) == (0, [-1.0, -1.0])


def test_bench_logs_with_and_without_seconds(spark, tmp_path):
    text = "loading\n\n===== run_a =====\nLoading datasets...\n  lambada: 0.1234  (12s)\n  niah: 1.0000\n\n===== run_b =====\n  lambada: 0.2000  (3s)\n"
    (tmp_path / "one.log").write_text(text)
    (tmp_path / "two.log").write_text("===== run_c =====\n  niah: 0.5000  (7s)\n")
    got = {(r.tag, r.task, r.score, r.seconds) for r in L.read_bench_logs(spark, f"{tmp_path}/*.log").collect()}
    assert got == {("run_a", "lambada", 0.1234, 12), ("run_a", "niah", 1.0, None), ("run_b", "lambada", 0.2, 3), ("run_c", "niah", 0.5, 7)}
    rows = L.read_bench_logs(spark, f"{tmp_path}/*.log")
    assert [r.tag for r in N.finished(rows, "tag", ["lambada", "niah"]).collect()] == ["run_a"]


def test_training_logs(spark, tmp_path):
    text = (
        "====\n  Device: cuda\n"
        "  step     10/9536 | loss 10.5000 | ppl 36315.5 | grad 1.250 | lr 1.20e-05 | tok/s 16783\n"
        "  step    500/9536 | loss nan | ppl 1.0 | grad 0.100 | lr 6.00e-04 | tok/s 16000\n"
        "  >>> val_loss=3.2100  val_ppl=24.8\n  Checkpoint saved: x\n"
    )
    (tmp_path / "t.log").write_text(text)
    rows = L.read_training_logs(spark, str(tmp_path / "t.log")).orderBy("step").collect()
    assert [(r.step, r.total_steps, r.lr, r.tokens_per_second, r.val_loss) for r in rows] == [
        (10, 9536, 1.2e-05, 16783.0, None), (500, 9536, 6e-4, 16000.0, 3.21),
    ]
    assert rows[0].loss == 10.5 and np.isnan(rows[1].loss)


def test_checkpoint_manifest_reads_no_content(spark, tmp_path):
    for name in ("phase1_a/step_000500.pt", "phase1_a/final.pt", "phase2_b_c/step_1234567.pt", "phase1_a/notes.txt", "other/x.pt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = CK.read_checkpoints(spark, str(tmp_path))
    rows = {(r.phase, r.model, r.step, r.is_final, r.length) for r in found.collect()}
    assert rows == {(1, "a", 500, False, 5), (1, "a", None, True, 5), (2, "b_c", 1234567, False, 5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile [path" in plan and "content" not in plan


def test_preferred_metric(spark):
    rows = [("a", {"acc,none": 0.5, "acc_norm,none": 0.6}), ("b", {"acc_norm,none": 0.7}), ("c", {"f1": 0.1})]
    frame = spark.createDataFrame(rows, "task string, metrics map<string, double>")
    assert {tuple(r) for r in J.bench_metrics(frame).collect()} == {("bench/a_acc", 0.5), ("bench/b_acc", 0.7)}


def test_task_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("niah", 1.0), ("lambada", 0.25)], "task string, accuracy double")
    J.write_task_results(rows, "run_a", str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"run_a":{"lambada":0.25,"niah":1.0}}']
    got = {tuple(r) for r in J.read_task_results(spark, str(tmp_path / "r")).collect()}
    assert got == {("run_a", "niah", 1.0), ("run_a", "lambada", 0.25)}


def test_item_and_document_readers(spark, tmp_path):
    lines = {
        "lambada": {"item_id": 1, "text": "a b", "other": 1},
        "hellaswag": {"item_id": 1, "ctx": "c", "endings": ["x", "y"], "label": "1"},
        "arc_easy": {"item_id": 1, "question": "q", "choices": {"text": ["a"], "label": ["A"]}, "answerKey": "A"},
        "winogrande": {"item_id": 1, "sentence": "_", "option1": "x", "option2": "y", "answer": "2"},
    }
    for task, record in lines.items():
        (tmp_path / f"{task}.json").write_text(json.dumps(record) + "\n")
        assert I.read_items(spark, task, str(tmp_path / f"{task}.json")).count() == 1
    assert I.read_items(spark, "arc_easy", str(tmp_path / "arc_easy.json")).first().choices.text == ["a"]
    (tmp_path / "docs.json").write_text('{"doc_id": 1, "text": "a"}\n{"doc_id": 2}\n')
    docs = I.read_documents(spark, str(tmp_path / "docs.json"), "json")
    assert C.corpus_totals(docs).first().n_docs == 1
    assert I.stream_documents(spark, str(tmp_path), "json").isStreaming
    with pytest.raises(ValueError):
        I.read_items(spark, "unknown", "x")


def test_own_folder_without_a_setting(spark):
    from weftline import session

    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(key, default):
                return default

    first = session.shared_dir(Unset)
    assert os.path.isdir(first) and session.shared_dir(Unset) == first
