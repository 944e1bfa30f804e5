"""Token stream, packing, shards and batches on tiny inputs with known answers."""

import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import batches as B
from weftline.operators import corpus as C
from weftline.operators import packing as P
from weftline.operators import prefix as X
from weftline.operators import shards as S

relaxed = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def encoded_of(spark, docs):
    """Encoded documents from lists of ids."""
    rows = [(i, len(ids), ids) for i, ids in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>")


def one_document(spark, n):
    return C.token_spans(encoded_of(spark, [list(range(n))]))


def tokens(blocks):
    return [r["tokens"] for r in blocks.orderBy("block_id").collect()]


def test_empty_texts_are_dropped_and_end_marker_is_added(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a b")], "doc_id long, text string")
    vocab = C.vocabulary(docs)
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", C.RESERVED), ("b", C.RESERVED + 1)]
    got = {r.doc_id: r.ids for r in C.encoded_corpus(docs, C.native_encoder(vocab)).collect()}
    assert got == {3: [0], 4: [C.RESERVED, C.RESERVED + 1, 0]}
    assert C.corpus_totals(docs).first().asDict() == {"n_docs": 2, "n_tokens": 4}


def test_words_outside_the_vocabulary_are_spelled_out(spark):
    docs = spark.createDataFrame([(1, "a a b b é"), (2, " "), (3, "xyz a")], "doc_id long, text string")
    size = C.RESERVED + 2
    vocab = C.vocabulary(docs, size)
    encode = C.native_encoder(vocab, size)
    a, b = C.RESERVED, C.RESERVED + 1
    spelled = [C.SPELLED_ID, *[x + C.FIRST_BYTE_ID for x in "é".encode()]]
    corpus = C.encoded_corpus(docs, encode)
    got = {r.doc_id: r.ids for r in corpus.collect()}
    assert got == {1: [a, a, b, b, *spelled, 0], 2: [0], 3: [C.SPELLED_ID, *[x + C.FIRST_BYTE_ID for x in b"xyz"], a, 0]}
    assert C.corpus_totals(docs, encode).first().asDict() == {"n_docs": 3, "n_tokens": sum(map(len, got.values()))}
    rows = spark.createDataFrame([(d, i, t) for d, ids in got.items() for i, t in enumerate(ids[:-1])], "doc_id long, pos int, token_id int")
    assert {r.doc_id: r.text for r in C.decode(rows, vocab, "doc_id", "pos").collect()} == {1: "a a b b é", 3: "xyz a"}
    with pytest.raises(ValueError):
        C.native_encoder(C.vocabulary(docs), size=70_000)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 50])
def test_vocabulary_is_the_most_frequent(spark, size):
    docs = spark.createDataFrame([(1, "a a a b b c c d e")], "doc_id long, text string")
    got = C.vocabulary(docs, C.RESERVED + size).orderBy("token_id").collect()
    assert [(r.token, r.n) for r in got] == [("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1)][:size]


def test_custom_encoder_without_end_marker(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    encode = C.custom_encoder(lambda text: [ord(c) for c in text], None)
    assert [r.ids for r in C.encoded_corpus(docs, encode).collect()] == [[97, 98, 99, 0]]


def test_decode(spark):
    vocab = spark.createDataFrame([("a", 300), ("b", 301)], "token string, token_id int")
    rows = spark.createDataFrame([(1, 1, 301), (1, 0, 300), (1, 2, 999)], "case_id long, pos int, token_id int")
    assert C.decode(rows, vocab, "case_id", "pos").first().text == "a b ?"


@pytest.mark.parametrize("available, kept, shards", [(90, 90, 1), (100, 100, 1), (170, 150, 2), (250, 200, 2)])
def test_budget_is_cut_at_shard_borders(spark, available, kept, shards):
    assert S.kept_tokens(available, 100, 150) == kept
    spans = one_document(spark, available)
    sizes = S.shard_sizes(S.shard_assignment(spans, 100, S.kept_tokens(available, 100, 150)))
    assert sizes.count() == shards
    assert sizes.agg(F.sum("n_tokens")).first()[0] == kept
    pieces = S.shard_pieces(spans, 100, kept)
    assert pieces.agg(F.sum(F.size("piece"))).first()[0] == kept


def test_local_packing(spark):
    assert tokens(P.overlapping_blocks(one_document(spark, 10), 4)) == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8]]
    assert len(tokens(P.overlapping_blocks(one_document(spark, 9), 4))) == 2
    for n in (0, 1):
        assert tokens(P.overlapping_blocks(one_document(spark, n), 4)) == []
        assert P.num_overlapping_blocks(n, 4) == 0


def test_token_cap(spark):
    spans = one_document(spark, 20)
    assert len(tokens(P.overlapping_blocks(spans, 4, 9))) == P.num_overlapping_blocks(20, 4, 9) == 2
    assert len(tokens(P.overlapping_blocks(spans, 4, 0))) == 4
    assert len(tokens(P.disjoint_blocks(spans, 4, 6))) == 2


def test_streaming_packing_drops_the_remainder(spark):
    spans = C.token_spans(encoded_of(spark, [[0, 1, 2], list(range(3, 11))]))
    assert tokens(P.disjoint_blocks(spans, 4)) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_shift(spark):
    block = spark.createDataFrame([(0, [0, 1, 2, 3, 4])], "block_id long, tokens array<int>")
    row = P.next_token_pairs(block).first()
    assert (row.input_ids, row.labels) == ([0, 1, 2, 3], [1, 2, 3, 4])


@relaxed
@given(st.lists(st.integers(1, 23), min_size=1, max_size=12), st.integers(2, 7), st.integers(1, 4))
def test_packing_equals_brute_force(spark, sizes, seq_len, ranges):
    flat = list(range(sum(sizes)))
    docs, at = [], 0
    for n in sizes:
        docs.append(flat[at : at + n])
        at += n
    encoded = encoded_of(spark, docs).repartition(3)
    cuts = X.range_cuts(encoded, "doc_id", ranges)
    spans = X.running_total(encoded, "doc_id", "n_tokens", "start", cuts=cuts)
    local = [flat[b * seq_len : b * seq_len + seq_len + 1] for b in range((len(flat) - 1) // seq_len)]
    step = seq_len + 1
    disjoint = [flat[b * step : (b + 1) * step] for b in range(len(flat) // step)]
    assert tokens(P.overlapping_blocks(spans, seq_len)) == local
    assert tokens(P.disjoint_blocks(spans, seq_len)) == disjoint


@relaxed
@given(
    st.lists(st.tuples(st.sampled_from("aab"), st.integers(-5, 5)), min_size=1, max_size=40), st.integers(1, 6), st.booleans()
)
def test_running_total_with_hot_groups(spark, rows, rows_per_range, grouped):
    """Groups of any size, split into ranges or not, give the plain running sum."""
    data = [(g, i * i, v) for i, (g, v) in enumerate(rows)]
    frame = spark.createDataFrame(data, "g string, o long, v long").repartition(3)
    kept = X.ROWS_PER_RANGE
    X.ROWS_PER_RANGE = rows_per_range
    try:
        by = ["g"] if grouped else []
        more = {"first": {"opened": "v"}} if grouped else {}
        got = {(r.g, r.o): r for r in X.running_total(frame, "o", "v", "before", by, **more).collect()}
    finally:
        X.ROWS_PER_RANGE = kept
    assert len(got) == len(data)
    for g, o, _ in data:
        group = [(b, v) for a, b, v in data if a == g or not grouped]
        assert got[g, o].before == sum(v for b, v in group if b < o)
        if grouped:
            assert got[g, o].opened == min(group)[1]


def test_sparse_and_clustered_ids_give_the_same_offsets(spark):
    ids = [3, 5, 10**15, 10**15 + 1, 10**15 + 2, 2 * 10**18]
    frame = spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "doc_id long, n_tokens long")
    cuts = X.range_cuts(frame, "doc_id", 4)
    got = X.running_total(frame, "doc_id", "n_tokens", "start", cuts=cuts).orderBy("doc_id").collect()
    assert [r.start for r in got] == [0, 1, 3, 6, 10, 15]


def test_range_read_and_shard_lookup(spark):
    spans = C.token_spans(encoded_of(spark, [list(range(10)), list(range(10, 25))]))
    got = S.read_range(spans, 8, 5).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in got] == [(i, i) for i in range(8, 13)]
    sizes = spark.createDataFrame([(0, 7), (1, 0), (2, 1), (3, 20)], "shard_id long, n_tokens long")
    where = S.locate_positions(spark.range(25).withColumnRenamed("id", "pos"), S.shard_offsets(sizes))
    found = {r.pos: (r.shard_id, r.local_pos) for r in where.collect()}
    assert found == {p: (0, p) if p < 7 else (2, 0) if p == 7 else (3, p - 8) for p in range(25)}


def test_positions_and_shards_are_merged_in_ranges(spark, monkeypatch):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 3, 40, 4000]) for _ in range(300)]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    asked = [rng.randrange(-5, sum(sizes) + 50) for _ in range(2000)] + [starts[-1]] * 500 + [None, 0, sum(sizes) - 1, sum(sizes)]
    positions = spark.createDataFrame([(p, i, "x") for i, p in enumerate(asked)], "pos long, row long, n_tokens string")
    manifest = S.shard_offsets(spark.createDataFrame(list(enumerate(sizes)), "shard_id long, n_tokens long"))
    want = {}
    for row, p in enumerate(asked):
        if p is not None and 0 <= p < sum(sizes):
            shard = max(i for i, s in enumerate(starts) if sizes[i] and s <= p)
            want[row] = (p, "x", shard, p - starts[shard])
    for rows in (X.ROWS_PER_RANGE, 40):
        monkeypatch.setattr(X, "ROWS_PER_RANGE", rows)
        found = S.locate_positions(positions, manifest).collect()
        assert len(found) == len(want) and {r.row: (r.pos, r.n_tokens, r.shard_id, r.local_pos) for r in found} == want
    assert S.locate_positions(positions, manifest.limit(0)).count() == 0


def test_every_epoch_is_a_different_permutation(spark):
    places = B.shuffled_epochs(spark, 10, 3, 7)
    orders = {}
    for r in places.collect():
        orders.setdefault(r.epoch, {})[r.place] = r.block_id
    assert all(sorted(o) == sorted(o.values()) == list(range(10)) for o in orders.values())
    assert len({tuple(o[i] for i in range(10)) for o in orders.values()}) == 3
    plan = B.batches(places, 10, 4)
    assert plan.groupBy("epoch", "batch_id").count().where("count = 4").count() == 3 * 2 == plan.count() / 4


def test_schedule_ends_after_a_whole_step(spark):
    # 10 blocks of 4 tokens in batches of 2, two batches a step: 16 tokens a step
    plan = B.training_schedule(spark, 10, 4, 2, 2, 33, 1)
    assert plan.select("step").distinct().count() == 3
    assert plan.count() == 3 * 2 * 2
    assert plan.agg(F.max("epoch")).first()[0] == 1


def test_validation_splits(spark):
    assert B.head_range(100, 4, 3) == (0, 12) and B.head_range(10, 4, 50) == (0, 8)
    assert B.held_out_range(100, 2) == (96, 100)
    blocks = spark.range(100).select(F.col("id").alias("block_id"))
    tail = B.in_stream_order(blocks, 96, 100, 2).collect()
    assert {(r.block_id, r.batch_id, r.slot) for r in tail} == {(96, 0, 0), (97, 0, 1), (98, 1, 0), (99, 1, 1)}


@relaxed
@given(st.lists(st.integers(1, 9), min_size=1, max_size=15), st.integers(0, 70), st.integers(0, 40), st.sampled_from([1, 10**14]))
def test_spans_within_a_range(spark, sizes, low, width, gap):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i * gap, n, list(range(at, at + n))))
        at += n
    encoded = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>")
    kept = X.WEIGHT_PER_RANGE
    X.WEIGHT_PER_RANGE = 7
    try:
        got = sorted((r.doc_id, r.start) for r in C.spans_within(encoded, low, low + width).collect())
    finally:
        X.WEIGHT_PER_RANGE = kept
    want = [(d, ids[0]) for d, n, ids in rows if ids[0] < low + width and ids[0] + n > low]
    assert got == want


def test_blocks_between(spark):
    encoded = encoded_of(spark, [list(range(10)), list(range(10, 25)), list(range(25, 40))])
    whole = tokens(P.overlapping_blocks(C.token_spans(encoded), 4))
    assert tokens(P.blocks_between(encoded, 3, 7, 4)) == whole[3:7]


def test_zero_padding_never_cuts(spark):
    got = spark.createDataFrame([(7,), (12345,)], "n long").select(T.zero_padded(F.col("n"), 4)).collect()
    assert [r[0] for r in got] == ["0007", "12345"]


def test_weighted_cuts_are_even_with_heavy_rows_at_one_end(spark):
    """The last hundredth of the rows has half of all tokens."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "IF(id >= 19800, 10000L, 101L) AS n_tokens")
    cuts = X.range_cuts(rows, "doc_id", 16, weight="n_tokens")
    sizes = [r.n for r in X.with_range(rows, "doc_id", cuts).groupBy(X.RANGE).agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.5 * sum(sizes) / 16


def test_clustered_corpus_opens_only_the_zones_of_a_range(spark):
    rows = [(3 * i, 20 if i < 180 else 900, [i] * (20 if i < 180 else 900)) for i in range(200)]
    encoded = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>").repartition(5)
    table = C.clustered_corpus(encoded, 8)
    zones = table.zones.orderBy("zone").collect()
    assert len(zones) > 5 and table.total_tokens == zones[-1]["last"] == 180 * 20 + 20 * 900
    assert [z["last"] for z in zones[:-1]] == [z["first"] for z in zones[1:]] and zones[0]["first"] == 0
    assert max(z["last"] - z["first"] for z in zones) <= 2 * table.total_tokens / len(zones) + 900
    want = {r.doc_id: (r.start, r.n_tokens) for r in C.token_spans(encoded).collect()}
    assert {r.doc_id: (r.start, r.n_tokens) for r in table.spans.collect()} == want
    for low, high in [(0, 1), (3590, 3700), (5000, 9000), (21_599, 21_600)]:
        part = table.within(low, high)
        assert {r.doc_id for r in part.collect()} == {d for d, (s, n) in want.items() if s < high and s + n > low}
        part.write.format("noop").mode("overwrite").save()
        touched = {z["zone"] for z in zones if z["first"] < high and z["last"] > low}
        opened = {r.f.split("zone=")[1].split("/")[0] for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
        assert opened <= {str(z) for z in touched}
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(zone" in plan and "LessThan(start" in plan
    assert table.within(50_000, 60_000).count() == 0
    assert C.clustered_corpus(encoded.limit(0)).within(0, 10).count() == 0


def test_lookup_in_pieces_gives_the_same_ids(monkeypatch):
    words = pa.array([f"w{i}" for i in range(9)])
    rows = [None if i % 7 == 3 else [["w1", "é", "w8", "xyz", "日本"][(i + j) % 5] for j in range(i % 13)] for i in range(60)]
    known = {w: i + C.RESERVED for i, w in enumerate(words.to_pylist())}
    plain = [[x for w in row or [] for x in ([known[w]] if w in known else [C.SPELLED_ID, *(b + C.FIRST_BYTE_ID for b in w.encode())])] for row in rows]
    tokens = pa.array([["w0"], *rows], pa.list_(pa.string())).slice(1)
    largest = []
    spelled_ids = C.spelled_ids
    monkeypatch.setattr(C, "spelled_ids", lambda part, listed: largest.append(len(part)) or spelled_ids(part, listed))
    for at_once in (1, 10, 1 << 18):
        monkeypatch.setattr(C, "TOKENS_AT_ONCE", at_once)
        largest.clear()
        assert C.list_ids(tokens, words).to_pylist() == plain
        assert max(largest) <= at_once


def test_encoding_reads_small_batches(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 20000) AS text").coalesce(1)
    sizes = F.arrow_udf(lambda texts: pa.array([[len(texts)]] * len(texts), pa.list_(pa.int32())), "array<int>")
    ids = C.encoded_corpus(docs, C.Encoder(sizes))
    assert ids.agg(F.max(F.get("ids", F.lit(0)))).first()[0] < 400  # 16 MB of text in more than one batch


def test_whole_arrays_decode_as_rows_do(spark, monkeypatch):
    monkeypatch.setattr(C, "TOKENS_AT_ONCE", 4)
    vocab = spark.createDataFrame([("a", C.RESERVED), ("é", C.RESERVED + 1)], "token string, token_id int")
    a, e = C.RESERVED, C.RESERVED + 1
    ids = [[a, e, a], [C.SPELLED_ID, *(b + C.FIRST_BYTE_ID for b in "日x".encode()), a], [0, a, 60_000], [C.SPELLED_ID, C.FIRST_BYTE_ID + 0xFF, e], [a] * 9]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    plain = C.decode(rows.select("doc_id", F.posexplode("ids").alias("pos", "token_id")), vocab, "doc_id", "pos")
    whole = rows.select("doc_id", C.decoded_text(vocab)(F.col("ids")).alias("text"))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.text for r in whole.collect()} == {r.doc_id: r.text for r in plain.collect()}


def test_total_from_token_counts(spark):
    docs = spark.createDataFrame([(0, "a a b é"), (1, ""), (2, None), (3, "xyz 日本 a!"), (4, " ")], "doc_id long, text string")
    for size in (C.RESERVED + 1, C.RESERVED + 3, C.VOCABULARY_SIZE):
        counts = C.token_counts(docs)
        vocab = C.vocabulary_of(counts, size)
        assert C.native_total(docs, counts, vocab) == C.total_tokens(docs, C.native_encoder(vocab))
    empty = docs.limit(0)
    assert C.native_total(empty, C.token_counts(empty), C.vocabulary(empty)) == 0
