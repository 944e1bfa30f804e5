"""Corpus preparation and training-set serving over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.permutation import permuted_sql, round_keys
from weftline.operators import batches as B
from weftline.operators import corpus as C
from weftline.operators import packing as P
from weftline.operators import shards as S
from weftline.plans.tables import ACCUMULATE, IDS_SQL, MICRO_BATCH, SEED, SEQ_LEN, SHARD_SIZE, TOKENS_SQL, table
from weftline.session import fresh_path, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def encoder(docs: DataFrame) -> C.Encoder:
    return C.native_encoder(C.vocabulary(docs))


def encoded(docs: DataFrame) -> DataFrame:
    return C.encoded_corpus(docs, encoder(docs))


def offsets_of(docs: DataFrame) -> DataFrame:
    return C.token_offsets(docs, encoder(docs))


def encoded_spans(docs: DataFrame) -> DataFrame:
    return C.token_spans(encoded(docs))


def _digest(ids: str):
    """Digest of an id array by its text form, ``[1, 2, 3]``."""
    return F.md5(F.col(ids).cast("string"))


def describe_blocks(blocks: DataFrame) -> DataFrame:
    pairs = P.next_token_pairs(blocks)
    return pairs.select(
        "block_id",
        F.size("input_ids").cast("bigint").alias("n_tokens"),
        _digest("input_ids").alias("input_md5"),
        _digest("labels").alias("label_md5"),
    )


def corpus_totals(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return C.corpus_totals(docs, encoder(docs)).withColumn("n_shards", F.expr(f"(n_tokens + {SHARD_SIZE - 1}) div {SHARD_SIZE}"))


def token_offsets(spark, sf_dir):
    return offsets_of(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens")


def vocab_ids(spark, sf_dir):
    vocab = C.vocabulary(documents(spark, sf_dir))
    return vocab.select("token", F.col("token_id").cast("bigint").alias("token_id"), "n")


def encoded_documents(spark, sf_dir):
    return encoded(documents(spark, sf_dir)).select(
        "doc_id",
        "n_tokens",
        _digest("ids").alias("ids_md5"),
        F.size(F.filter("ids", lambda x: x == C.SPELLED_ID)).cast("bigint").alias("n_spelled"),
    )


def _half_budget(total: int) -> int:
    return S.kept_tokens(total, SHARD_SIZE, total // 2 + 1)


def shard_assignment(spark, sf_dir):
    offsets = offsets_of(documents(spark, sf_dir))
    return S.shard_assignment(offsets, SHARD_SIZE, _half_budget(C.tokens_in(offsets)))


def shard_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sizes = S.shard_sizes(S.shard_assignment(offsets_of(docs), SHARD_SIZE))
    return S.shard_offsets(sizes).select("shard_id", "start", "n_tokens", "n_pieces")


def manifest_facts(spark, sf_dir):
    offsets = offsets_of(documents(spark, sf_dir))
    sizes = S.shard_sizes(S.shard_assignment(offsets, SHARD_SIZE, _half_budget(C.tokens_in(offsets))))
    facts = {"vocab_size": C.VOCABULARY_SIZE, "eos_id": C.END_ID, "dataset": "documents", "tokenizer": "native"}
    return S.manifest_row(sizes, **facts).select(
        *[F.col(c).cast("bigint") for c in ("total_tokens", "num_shards", "vocab_size", "eos_id")],
        "dtype", "dataset", "tokenizer",
    )


def pack_blocks_local(spark, sf_dir):
    return describe_blocks(P.overlapping_blocks(encoded_spans(documents(spark, sf_dir)), SEQ_LEN))


def pack_blocks_streaming(spark, sf_dir):
    return describe_blocks(P.disjoint_blocks(encoded_spans(documents(spark, sf_dir)), SEQ_LEN))


def pack_blocks_capped(spark, sf_dir):
    ids = encoded(documents(spark, sf_dir))
    cap = C.tokens_in(ids) // 2
    return describe_blocks(P.overlapping_blocks(C.spans_within(ids, 0, cap), SEQ_LEN, cap))


def range_read(spark, sf_dir):
    ids = encoded(documents(spark, sf_dir))
    total = C.tokens_in(ids)
    first, count = total // 3, total // 10
    return S.read_range(C.spans_within(ids, first, first + count), first, count).select("pos", F.col("token").cast("bigint").alias("token"))


def position_shards(spark, sf_dir):
    """Which shard holds each document's first token, for shards of uneven size (one per source)."""
    docs = documents(spark, sf_dir)
    offsets = offsets_of(docs)
    by_source = offsets.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    manifest = S.shard_offsets(
        by_source.select(F.substring("source", 4, 10).cast("bigint").alias("shard_id"), "n_tokens")
    )
    positions = offsets.select("doc_id", F.col("start").alias("pos"))
    return S.locate_positions(positions, manifest).select("doc_id", "pos", "shard_id", "local_pos")


def shard_roundtrip(spark, sf_dir):
    """Write the shards, read them back, and describe each by totals that depend on order."""
    from weftline.sources.token_shards import read_shards, write_shards

    docs = documents(spark, sf_dir)
    path = fresh_path(spark, "shards")
    pieces = S.shard_pieces(encoded_spans(docs), SHARD_SIZE)
    write_shards(pieces, path, vocab_size=C.VOCABULARY_SIZE, eos_id=C.END_ID, dataset="documents", tokenizer="native")
    rows = read_shards(spark, path)
    return rows.groupBy(F.expr(f"pos div {SHARD_SIZE}").alias("shard_id")).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min("pos").alias("first_pos"),
        F.sum(F.col("token").cast("bigint")).alias("token_sum"),
        F.sum((F.col("pos") % 65_536) * F.col("token")).alias("placed_sum"),
    )


def shard_blocks(spark, sf_dir):
    """Blocks served from the shards: each task reads its own byte range, nothing is shuffled."""
    from weftline.sources.token_shards import read_shard_blocks, write_shards

    docs = documents(spark, sf_dir)
    path = fresh_path(spark, "shards")
    pieces = S.shard_pieces(encoded_spans(docs), SHARD_SIZE)
    write_shards(pieces, path, vocab_size=C.VOCABULARY_SIZE, eos_id=C.END_ID, dataset="documents", tokenizer="native")
    return describe_blocks(read_shard_blocks(spark, path, SEQ_LEN))


def _written_shards(spark, sf_dir) -> tuple[str, int]:
    """Path of fresh shards of the documents, and their tokens."""
    from weftline.sources.token_shards import write_shards

    ids = encoded(documents(spark, sf_dir))
    path = fresh_path(spark, "shards")
    pieces = S.shard_pieces(C.token_spans(ids), SHARD_SIZE)
    write_shards(pieces, path, vocab_size=C.VOCABULARY_SIZE, eos_id=C.END_ID, dataset="documents", tokenizer="native")
    return path, C.tokens_in(ids)


def shard_range_read(spark, sf_dir):
    """A range of positions by a filter that the shard source takes: files outside it are not opened."""
    from weftline.sources.token_shards import read_shards

    path, total = _written_shards(spark, sf_dir)
    first, count = total // 3, total // 10
    inside = (F.col("pos") >= first) & (F.col("pos") < first + count)
    return read_shards(spark, path).where(inside).select("pos", F.col("token").cast("bigint").alias("token"))


def clustered_range_read(spark, sf_dir):
    """The same range from the table clustered by position: only the files of its zones are opened."""
    table = C.clustered_corpus(encoded(documents(spark, sf_dir)))
    total = table.total_tokens
    first, count = total // 3, total // 10
    return S.read_range(table.within(first, first + count), first, count).select("pos", F.col("token").cast("bigint").alias("token"))


def _described_training(batches: DataFrame) -> DataFrame:
    digests = [_digest(side).alias(f"{side}_md5") for side in ("input_ids", "labels")]
    return batches.select("epoch", "batch_id", "slot", "block_id", *digests)


def training_batches(spark, sf_dir):
    """Two passes of batches with their tokens; every block finds its places itself."""
    from weftline.sources.token_shards import read_shard_blocks

    path, total = _written_shards(spark, sf_dir)
    blocks = read_shard_blocks(spark, path, SEQ_LEN)
    return _described_training(B.training_batches(blocks, _num_blocks(total), MICRO_BATCH, 2, SEED))


def served_batches(spark, sf_dir):
    """The same batches in training order, read from the shards by the tasks that serve them."""
    from weftline.sources.token_shards import read_training_batches

    path, _ = _written_shards(spark, sf_dir)
    return _described_training(read_training_batches(spark, path, SEQ_LEN, MICRO_BATCH, 2, SEED))


def _num_blocks(total: int) -> int:
    return P.num_overlapping_blocks(total, SEQ_LEN)


def epoch_batches(spark, sf_dir):
    docs = documents(spark, sf_dir)
    blocks = _num_blocks(C.total_tokens(docs, encoder(docs)))
    plan = B.batches(B.shuffled_epochs(spark, blocks, 2, SEED), blocks, MICRO_BATCH)
    return plan.select(*[F.col(c).cast("bigint") for c in ("epoch", "batch_id", "slot", "block_id")])


def epoch_repeat(spark, sf_dir):
    docs = documents(spark, sf_dir)
    total = C.total_tokens(docs, encoder(docs))
    blocks = _num_blocks(total)
    plan = B.training_schedule(spark, blocks, SEQ_LEN, MICRO_BATCH, ACCUMULATE, total * 5 // 2, SEED)
    columns = ("epoch", "batch_id", "slot", "block_id", "micro_step", "step")
    return plan.select(*[F.col(c).cast("bigint") for c in columns])


def _described_batches(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        F.col("batch_id").cast("bigint"), F.col("slot").cast("bigint"), "block_id", _digest("tokens").alias("block_md5")
    )


def _validation(ids: DataFrame, first: int, last: int) -> DataFrame:
    return _described_batches(B.in_stream_order(P.blocks_between(ids, first, last, SEQ_LEN), first, last, MICRO_BATCH))


def validation_batches_head(spark, sf_dir):
    ids = encoded(documents(spark, sf_dir))
    return _validation(ids, *B.head_range(_num_blocks(C.tokens_in(ids)), MICRO_BATCH, 50))


def validation_batches_tail(spark, sf_dir):
    ids = encoded(documents(spark, sf_dir))
    return _validation(ids, *B.held_out_range(_num_blocks(C.tokens_in(ids)), MICRO_BATCH))


QUERIES = {
    "corpus_totals": corpus_totals,
    "token_offsets": token_offsets,
    "vocab_ids": vocab_ids,
    "encoded_documents": encoded_documents,
    "shard_assignment": shard_assignment,
    "shard_manifest": shard_manifest,
    "manifest_facts": manifest_facts,
    "pack_blocks_local": pack_blocks_local,
    "pack_blocks_streaming": pack_blocks_streaming,
    "pack_blocks_capped": pack_blocks_capped,
    "range_read": range_read,
    "position_shards": position_shards,
    "shard_roundtrip": shard_roundtrip,
    "shard_blocks": shard_blocks,
    "shard_range_read": shard_range_read,
    "clustered_range_read": clustered_range_read,
    "training_batches": training_batches,
    "served_batches": served_batches,
    "epoch_batches": epoch_batches,
    "epoch_repeat": epoch_repeat,
    "validation_batches_head": validation_batches_head,
    "validation_batches_tail": validation_batches_tail,
}

# --- the same answers in SQL -------------------------------------------------------------------

_KEPT_SQL = f"""
budget AS (SELECT t, t // 2 + 1 AS n FROM total),
whole AS (SELECT t, n, least(t // {SHARD_SIZE}, (n + {SHARD_SIZE - 1}) // {SHARD_SIZE}) * {SHARD_SIZE} AS w FROM budget),
kept AS (SELECT CASE WHEN w >= n THEN w ELSE w + least(t - w, n - w) END AS k FROM whole)"""

_ASSIGN_SQL = f"""
trimmed AS (SELECT doc_id, start, least(n_tokens, k - start) AS n_tokens FROM offsets, kept WHERE start < k),
spread AS (
    SELECT doc_id, start, n_tokens, unnest(range(start // {SHARD_SIZE}, (start + n_tokens - 1) // {SHARD_SIZE} + 1)) AS shard_id
    FROM trimmed
),
assigned AS (
    SELECT doc_id, shard_id, greatest(start, shard_id * {SHARD_SIZE}) AS lo,
           least(start + n_tokens, (shard_id + 1) * {SHARD_SIZE}) - greatest(start, shard_id * {SHARD_SIZE}) AS n_tokens
    FROM spread
)"""


def _block_rows(stride: int, limit: str) -> str:
    """Tokens keyed by block; with stride SEQ_LEN a border token belongs to two blocks."""
    repeat = (
        f"UNION ALL SELECT pos // {stride} - 1, pos, id FROM stream WHERE pos % {stride} = 0 AND pos > 0"
        if stride == SEQ_LEN
        else ""
    )
    return f"""
block_rows AS (SELECT pos // {stride} AS block_id, pos, id FROM stream {repeat}),
blocks AS (
    SELECT block_id, list(id ORDER BY pos) AS ids FROM block_rows, total WHERE block_id < {limit} GROUP BY block_id
)"""


_DESCRIBE_SQL = """
SELECT block_id, (len(ids) - 1)::BIGINT AS n_tokens,
       md5(ids[:-2]::VARCHAR) AS input_md5, md5(ids[2:]::VARCHAR) AS label_md5
FROM blocks"""


def streaming_blocks_sql(limit: str) -> str:
    """Blocks that share nothing, below the number ``limit``."""
    return f"WITH {IDS_SQL}, {_block_rows(SEQ_LEN + 1, limit)} {_DESCRIBE_SQL}"


_LOCAL_BLOCKS = _block_rows(SEQ_LEN, f"(t - 1) // {SEQ_LEN}")

_EPOCHS_SQL = f"""
n AS (SELECT (t - 1) // {SEQ_LEN} AS blocks, t FROM total),
ids AS (SELECT unnest(range(blocks)) AS block_id FROM n)"""

_PLACES_SQL = f"""
places AS (
    SELECT epoch, block_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || block_id)) - 1 AS place
    FROM ids, epochs
),
batched AS (
    SELECT epoch, place // {MICRO_BATCH} AS batch_id, place % {MICRO_BATCH} AS slot, block_id
    FROM places, n WHERE place // {MICRO_BATCH} < blocks // {MICRO_BATCH}
)"""

_PERMUTED = permuted_sql(f"SELECT greatest(t - 1, 0) // {SEQ_LEN} AS n FROM total", "epoch", "rounds")

#: Two passes of batches with their tokens, by the computed permutation.
_TRAINING_SQL = f"""WITH RECURSIVE {IDS_SQL}, {_LOCAL_BLOCKS}, {_EPOCHS_SQL},
rounds(epoch, r, f, s) AS (VALUES {", ".join(f"({e}, {r}, {f}::BIGINT, {s}::BIGINT)" for e in (0, 1) for r, (f, s) in enumerate(round_keys(SEED, e)))}),
places AS (SELECT epoch::BIGINT AS epoch, unnest(range(blocks)) AS place FROM n, (SELECT unnest(range(2)) AS epoch)),
{_PERMUTED}
SELECT epoch, place // {MICRO_BATCH} AS batch_id, place % {MICRO_BATCH} AS slot, block_id,
       md5(ids[:{SEQ_LEN}]::VARCHAR) AS input_ids_md5, md5(ids[2:]::VARCHAR) AS labels_md5
FROM permuted JOIN blocks USING (block_id), grid WHERE place // {MICRO_BATCH} < n // {MICRO_BATCH}"""

_STEP = MICRO_BATCH * SEQ_LEN * ACCUMULATE

SQL = {
    "corpus_totals": f"""WITH {TOKENS_SQL}
SELECT count(*) AS n_docs, coalesce(sum(n_tokens), 0)::BIGINT AS n_tokens,
       ((coalesce(sum(n_tokens), 0) + {SHARD_SIZE - 1}) // {SHARD_SIZE})::BIGINT AS n_shards FROM sized""",
    "token_offsets": f"WITH {TOKENS_SQL} SELECT doc_id, start, n_tokens FROM offsets",
    "vocab_ids": f"WITH {IDS_SQL} SELECT token, token_id, n FROM vocab",
    "encoded_documents": f"""WITH {IDS_SQL}
SELECT doc_id, count(*) AS n_tokens, md5(list(id ORDER BY i)::VARCHAR) AS ids_md5, count(*) FILTER (WHERE id = 1) AS n_spelled
FROM id_rows GROUP BY doc_id""",
    "shard_assignment": f"WITH {TOKENS_SQL}, {_KEPT_SQL}, {_ASSIGN_SQL} SELECT * FROM assigned",
    "shard_manifest": f"""WITH {TOKENS_SQL}, kept AS (SELECT t AS k FROM total), {_ASSIGN_SQL},
sizes AS (SELECT shard_id, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_pieces FROM assigned GROUP BY shard_id)
SELECT shard_id, n_tokens, n_pieces, (sum(n_tokens) OVER (ORDER BY shard_id) - n_tokens)::BIGINT AS start FROM sizes""",
    "manifest_facts": f"""WITH {TOKENS_SQL}, {_KEPT_SQL}
SELECT k::BIGINT AS total_tokens, ((k + {SHARD_SIZE - 1}) // {SHARD_SIZE})::BIGINT AS num_shards,
       {C.VOCABULARY_SIZE}::BIGINT AS vocab_size, 0::BIGINT AS eos_id, 'uint16' AS dtype, 'documents' AS dataset, 'native' AS tokenizer
FROM kept""",
    "pack_blocks_local": f"WITH {IDS_SQL}, {_LOCAL_BLOCKS} {_DESCRIBE_SQL}",
    "pack_blocks_streaming": streaming_blocks_sql(f"t // {SEQ_LEN + 1}"),
    "pack_blocks_capped": f"WITH {IDS_SQL}, {_block_rows(SEQ_LEN, f'(t // 2 - 1) // {SEQ_LEN}')} {_DESCRIBE_SQL}",
    "range_read": f"WITH {IDS_SQL} SELECT pos, id AS token FROM stream, total WHERE pos >= t // 3 AND pos < t // 3 + t // 10",
    "shard_range_read": f"WITH {IDS_SQL} SELECT pos, id AS token FROM stream, total WHERE pos >= t // 3 AND pos < t // 3 + t // 10",
    "clustered_range_read": f"WITH {IDS_SQL} SELECT pos, id AS token FROM stream, total WHERE pos >= t // 3 AND pos < t // 3 + t // 10",
    "position_shards": f"""WITH {TOKENS_SQL},
sources AS (
    SELECT substr(source, 4)::BIGINT AS shard_id, sum(n_tokens)::BIGINT AS n FROM sized JOIN documents USING (doc_id) GROUP BY source
),
bounds AS (SELECT shard_id, n, sum(n) OVER (ORDER BY shard_id) - n AS s FROM sources)
SELECT doc_id, start AS pos, shard_id, (start - s)::BIGINT AS local_pos FROM offsets JOIN bounds ON start >= s AND start < s + n""",
    "shard_roundtrip": f"""WITH {IDS_SQL}
SELECT pos // {SHARD_SIZE} AS shard_id, count(*) AS n_tokens, min(pos) AS first_pos, sum(id)::BIGINT AS token_sum,
       sum((pos % 65536) * id)::BIGINT AS placed_sum
FROM stream GROUP BY 1""",
    "shard_blocks": f"WITH {IDS_SQL}, {_LOCAL_BLOCKS} {_DESCRIBE_SQL}",
    "training_batches": _TRAINING_SQL,
    "served_batches": _TRAINING_SQL,
    "epoch_batches": f"""WITH {TOKENS_SQL}, {_EPOCHS_SQL}, epochs AS (SELECT unnest(range(2)) AS epoch), {_PLACES_SQL}
SELECT * FROM batched""",
    "epoch_repeat": f"""WITH {TOKENS_SQL}, {_EPOCHS_SQL},
target AS (
    SELECT blocks // {MICRO_BATCH} AS per_epoch, ((t * 5 // 2 + {_STEP - 1}) // {_STEP}) * {ACCUMULATE} AS micros FROM n
),
epochs AS (SELECT unnest(range((micros + per_epoch - 1) // per_epoch)) AS epoch FROM target), {_PLACES_SQL}
SELECT epoch, batch_id, slot, block_id, epoch * per_epoch + batch_id AS micro_step,
       (epoch * per_epoch + batch_id) // {ACCUMULATE} + 1 AS step
FROM batched, target WHERE epoch * per_epoch + batch_id < micros""",
    "validation_batches_head": f"""WITH {IDS_SQL}, {_LOCAL_BLOCKS}
SELECT block_id // {MICRO_BATCH} AS batch_id, block_id % {MICRO_BATCH} AS slot, block_id, md5(ids::VARCHAR) AS block_md5
FROM blocks, total
WHERE block_id // {MICRO_BATCH} < least(50, ((t - 1) // {SEQ_LEN}) // {MICRO_BATCH})""",
    "validation_batches_tail": f"""WITH {IDS_SQL}, {_LOCAL_BLOCKS},
held AS (
    SELECT nb - nb // 20 // {MICRO_BATCH} * {MICRO_BATCH} AS f
    FROM (SELECT (t - 1) // {SEQ_LEN} AS nb FROM total)
)
SELECT (block_id - f) // {MICRO_BATCH} AS batch_id, (block_id - f) % {MICRO_BATCH} AS slot, block_id,
       md5(ids::VARCHAR) AS block_md5
FROM blocks, held WHERE block_id >= f""",
}
