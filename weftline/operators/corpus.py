"""Documents to token ids with global positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.prefix import RANGE, range_cuts, running_total, with_range
from weftline.session import fresh_path, small_batches, stage

END_ID = 0
#: Stands before a word that is spelled out, and the id of byte 0 in such a word.
SPELLED_ID = 1
FIRST_BYTE_ID = 2
RESERVED = FIRST_BYTE_ID + 256
# Fixed value: vocabulary size of the published token shards; ids must fit 16 bits.
VOCABULARY_SIZE = 50_277
LARGEST_ID = 65_535
#: Tokens that one lookup holds beside its batch.
TOKENS_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Encoder:
    """A tokenizer: text column to id-array column, and the id that ends a document."""

    ids: Callable[[Column], Column]
    end_id: int = END_ID

    def closed(self, text: Column) -> Column:
        """Ids with the end marker appended, also where the text gave no ids at all."""
        return F.concat(self.ids(text), F.array(F.lit(self.end_id)))


def present_documents(documents: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; null and empty texts are dropped."""
    return documents.select("doc_id", "text").where(T.is_present(F.col("text")))


def counted_documents(documents: DataFrame, encode: Encoder | None = None) -> DataFrame:
    """Present documents with ``n_tokens``, the end marker included: ids of ``encode``, or else native words."""
    size = T.word_count(F.col("text")) + 1 if encode is None else F.size(encode.closed(F.col("text"))).cast("bigint")
    return present_documents(documents).withColumn("n_tokens", size)


def corpus_totals(documents: DataFrame, encode: Encoder | None = None) -> DataFrame:
    return counted_documents(documents, encode).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
    )


def total_tokens(documents: DataFrame, encode: Encoder | None = None) -> int:
    return corpus_totals(documents, encode).first()["n_tokens"]


def tokens_in(sized: DataFrame) -> int:
    """Total of a frame that already has ``n_tokens``."""
    return sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]


def token_counts(documents: DataFrame) -> DataFrame:
    """``(token, n)`` of every native token, written once. Counting combines map-side, so one frequent token is no hot key."""
    words = present_documents(documents).select(F.explode(T.words(F.col("text"))).alias("token"))
    return stage(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")


def vocabulary(documents: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(token, token_id, n)``: the most frequent tokens, ties in token order."""
    return vocabulary_of(token_counts(documents), size)


def vocabulary_of(counts: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The vocabulary by given ``token_counts``; only the capped list is numbered."""
    kept = _most_frequent(counts, size - RESERVED)
    rank = F.row_number().over(W.orderBy(F.desc("n"), "token"))
    return kept.select("token", (rank + (RESERVED - 1)).cast("int").alias("token_id"), "n")


def native_total(documents: DataFrame, counts: DataFrame, vocab: DataFrame) -> int:
    """All ids of ``documents``, end markers included, from their ``token_counts``: no text is encoded.

    A token of the vocabulary is one id, another one a mark and its bytes.
    """
    n = F.col("n")
    spelled = counts.join(F.broadcast(vocab.select("token")), "token", "left_anti").agg(F.sum(n * F.octet_length("token"))).first()[0]
    return (counts.agg(F.sum(n)).first()[0] or 0) + (spelled or 0) + present_documents(documents).count()


def _most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the highest ``n``, ties in token order.

    A top-k alone would send ``k`` rows per task to the task that merges them. So the count at which ``k``
    rows are reached is found first, and all rows below it are dropped. There are few different counts: at
    most the square root of twice the number of tokens.
    """
    per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    reached = F.sum("m").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    least = per_count.withColumn("reached", reached).where(F.col("reached") >= k).agg(F.max("n")).first()[0]
    counts = counts.where(F.col("n") >= (least or 0))
    return counts.orderBy(F.desc("n"), "token").limit(k)


def spelled_ids(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``tokens`` in a row, and how many each token has."""
    known = pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False)
    spelled = known < 0
    spelled_tokens = tokens.filter(pa.array(spelled))
    m = pc.binary_length(spelled_tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.ones(len(known), np.int64)
    n[spelled] += m
    start = np.cumsum(n) - n
    ids = np.empty(int(n.sum()), np.int32)
    ids[start[~spelled]] = known[~spelled] + RESERVED
    ids[start[spelled]] = SPELLED_ID
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(spelled_tokens)], spelled_tokens), "")[0].as_buffer(), np.uint8)
    ids[np.repeat(start[spelled] + 1 - (np.cumsum(m) - m), m) + np.arange(len(raw))] = raw.astype(np.int32) + FIRST_BYTE_ID
    return ids, n


def row_pieces(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Stretches of rows that hold about ``TOKENS_AT_ONCE`` elements; a longer row is alone."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    first = 0
    while first < len(lists):
        last = max(int(np.searchsorted(ends, ends[first] + TOKENS_AT_ONCE, "right")) - 1, first + 1)
        yield lists.slice(first, last - first)
        first = last


def list_ids(tokens: pa.ListArray, words: pa.Array) -> pa.ListArray:
    """Each row's ids, looked up for about ``TOKENS_AT_ONCE`` tokens at a time, whatever the size of the batch; a null row has none."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    flat, ids, totals = tokens.flatten(), [np.empty(0, np.int32)], np.zeros(len(ends), np.int64)
    given = 0
    for first in range(0, len(flat), TOKENS_AT_ONCE):
        part, n = spelled_ids(flat.slice(first, TOKENS_AT_ONCE), words)
        ids.append(part)
        inside = slice(np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + len(n), "right"))
        totals[inside] = given + np.cumsum(n)[ends[inside] - first - 1]
        given += len(part)
    return pa.ListArray.from_arrays(pa.array(totals, pa.int32()), pa.array(np.concatenate(ids)))


def native_encoder(vocab: DataFrame, size: int = VOCABULARY_SIZE) -> Encoder:
    """Encoder over the native tokens that loses none.

    A word outside the vocabulary is spelled out: ``SPELLED_ID``, then one id for each of its UTF-8 bytes.
    The vocabulary has at most ``size`` rows, so it travels with the function. Splitting stays in
    the JVM; the lookup is one vectorised hash lookup per Arrow batch.
    """
    if size - 1 > LARGEST_ID:
        raise ValueError(f"vocabulary of {size} does not fit 16-bit ids")
    listed = vocab.orderBy("token_id").select("token").toPandas()["token"].tolist()
    if len(listed) > size:
        raise ValueError(f"vocabulary has {len(listed)} rows, more than {size}")

    words = pa.array(listed, pa.string())

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        ids = list_ids(tokens, words)
        pa.default_memory_pool().release_unused()  # what the lookup has freed goes back, not into the next batch's peak
        return ids

    return Encoder(lambda text: lookup(T.words(text)))


def custom_encoder(tokenize: Callable[[str], Iterable[int]], end_id: int | None) -> Encoder:
    """Encoder over a caller's tokenizer; an absent end marker counts as id 0."""

    @F.pandas_udf("array<int>")
    def encode_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: list(tokenize(text)))

    return Encoder(encode_batch, END_ID if end_id is None else end_id)


def decode(token_rows: DataFrame, vocab: DataFrame, group: str, order: str) -> DataFrame:
    """Ids back to text, one row per ``group``: words joined by a space in ``order``; ids that stand for nothing give ``?``.

    Each id becomes the hex form of what it adds to the text, so that spelled words join byte by byte.
    """
    named = token_rows.join(vocab.select("token", "token_id"), "token_id", "left")
    token_id = F.col("token_id")
    piece = (
        F.when(F.col("token").isNotNull(), F.hex(F.concat(F.lit(" "), "token")))
        .when(token_id == SPELLED_ID, F.hex(F.lit(" ")))
        .when(token_id.between(FIRST_BYTE_ID, RESERVED - 1), F.lpad(F.hex(token_id - FIRST_BYTE_ID), 2, "0"))
        .otherwise(F.hex(F.lit(" ?")))
    )
    pieces = F.sort_array(F.collect_list(F.struct(order, piece.alias("piece"))))
    joined = F.unhex(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""))
    return named.groupBy(group).agg(F.ltrim(F.make_valid_utf8(joined.cast("string"))).alias("text"))


def decoded_text(vocab: DataFrame) -> Callable[[Column], Column]:
    """``decode`` for whole arrays of ids: an array becomes text where it lies, without a row for each id.

    The vocabulary is bounded by 16-bit ids and travels with the function.
    """
    pieces = [b" ?"] * (LARGEST_ID + 1)
    pieces[SPELLED_ID] = b" "
    pieces[FIRST_BYTE_ID:RESERVED] = [bytes([b]) for b in range(256)]
    for row in vocab.select("token", "token_id").where(F.col("token").isNotNull()).collect():
        pieces[row["token_id"]] = b" " + row["token"].encode()
    table = pa.array(pieces, pa.binary())

    @F.arrow_udf("binary")
    def join(ids: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.binary())]
        for rows in row_pieces(ids):
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
            parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(rows.flatten())), b""))
        joined = pa.concat_arrays(parts)
        pa.default_memory_pool().release_unused()
        return joined

    return lambda ids: F.ltrim(F.make_valid_utf8(join(ids).cast("string")))


def token_offsets(documents: DataFrame, encode: Encoder | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens)``: where each document begins in the global token stream.

    The counts are written once (two numbers per document), so the text is read a single time
    although totals and positions both need them.
    """
    with small_batches(documents.sparkSession):
        counted = stage(counted_documents(documents, encode).select("doc_id", "n_tokens"), "sizes")
    return running_total(counted, "doc_id", "n_tokens", "start", cuts=range_cuts(counted, "doc_id"))


def encoded_corpus(documents: DataFrame, encode: Encoder) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` with end markers, written once to the shared folder.

    Everything after this reads ids: text is split and looked up a single time, and steps that need
    only counts do not read the ids either.
    """
    ids = present_documents(documents).select("doc_id", encode.closed(F.col("text")).alias("ids"))
    with small_batches(documents.sparkSession):
        return stage(ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids"), "encoded")


def token_spans(encoded: DataFrame) -> DataFrame:
    """Add ``start``, the global position of each encoded document's first token.

    Range totals read only the counts; the ids are shuffled once, by range.
    """
    return running_total(encoded, "doc_id", "n_tokens", "start", cuts=range_cuts(encoded, "doc_id", weight="n_tokens"))


@dataclass(frozen=True)
class ClusteredCorpus:
    """An encoded corpus laid out by position: ``zone`` is a folder of the table, and zones follow each other.

    ``spans`` has (doc_id, start, n_tokens, ids, zone), sorted by position in each zone; ``zones`` has one row for each of them:
    (zone, first, last), its positions ``[first, last)``.
    """

    spans: DataFrame
    zones: DataFrame

    @property
    def total_tokens(self) -> int:
        return self.zones.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]

    def within(self, low: int, high: int) -> DataFrame:
        """The spans that overlap positions ``[low, high)``: files of other zones are not opened, nothing is shuffled."""
        touched = self.zones.where((F.col("first") < high) & (F.col("last") > low)).agg(F.min("zone"), F.max("zone")).first()
        inside = F.col("zone").between(touched[0], touched[1]) if touched[0] is not None else F.lit(False)
        spans = self.spans.where(inside & (F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
        return spans.drop("zone")


def clustered_corpus(encoded: DataFrame, zones: int | None = None) -> ClusteredCorpus:
    """Write ``encoded`` once more in the order of its documents, in zones of about equal tokens.

    Positions are stored with the ids. Readers of ranges, and anything that works along the stream, take them from
    there instead of summing up and shuffling the corpus again.
    """
    cuts = range_cuts(encoded, "doc_id", zones, weight="n_tokens")
    spans = running_total(encoded, "doc_id", "n_tokens", "start", cuts=cuts)
    laid = with_range(spans, "doc_id", cuts).withColumnRenamed(RANGE, "zone").select("doc_id", "start", "n_tokens", "ids", "zone")
    spark = encoded.sparkSession
    path = fresh_path(spark, "clustered")
    laid.sortWithinPartitions("zone", "start").write.partitionBy("zone").parquet(path)
    table = spark.read.schema(laid.schema).parquet(path)
    zoned = table.groupBy("zone").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("n_tokens")).alias("last"))
    return ClusteredCorpus(table, stage(zoned, "zones"))


# Neighbouring doubles are at most this far apart for 64-bit ids.
_DOUBLE_GAP = 2048


def spans_within(encoded: DataFrame, low: int, high: int) -> DataFrame:
    """The spans that overlap positions ``[low, high)``, reading and shuffling little else.

    Token totals per id range (one row each) show which ranges matter; the others are left out by a
    filter on ``doc_id`` that reaches the scan, before any ids are read.
    """
    cuts = range_cuts(encoded, "doc_id", weight="n_tokens")
    ranged = with_range(encoded.select("doc_id", "n_tokens"), "doc_id", cuts)
    sizes = dict(ranged.groupBy(RANGE).agg(F.sum("n_tokens")).collect())
    passed, skipped, kept = 0, 0, []
    for r in range(len(cuts) + 1):
        if passed < high and passed + sizes.get(r, 0) > low:
            kept.append(r)
        elif not kept:
            skipped = passed + sizes.get(r, 0)
        passed += sizes.get(r, 0)
    if not kept:
        return running_total(encoded.limit(0), "doc_id", "n_tokens", "start", cuts=[])
    part = encoded
    if kept[0] > 0:
        edge = cuts[kept[0] - 1]
        part = part.where((F.col("doc_id") >= math.floor(edge) - _DOUBLE_GAP) & (F.col("doc_id").cast("double") >= edge))
    if kept[-1] < len(cuts):
        edge = cuts[kept[-1]]
        part = part.where((F.col("doc_id") <= math.ceil(edge) + _DOUBLE_GAP) & (F.col("doc_id").cast("double") < edge))
    inner = cuts[kept[0] : kept[-1]]
    spans = running_total(part, "doc_id", "n_tokens", "start", cuts=inner).withColumn("start", F.col("start") + skipped)
    return spans.where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))


def cut_at(spans: DataFrame, kept: int) -> DataFrame:
    """Only the first ``kept`` tokens of the stream; the document on the border is shortened."""
    left = F.lit(kept) - F.col("start")
    inside = spans.where(F.col("start") < kept)
    if "ids" in spans.columns:
        inside = inside.withColumn(
            "ids",
            F.when(left < F.col("n_tokens"), F.slice("ids", F.lit(1), left.cast("int"))).otherwise(F.col("ids")),
        )
    return inside.withColumn("n_tokens", F.least("n_tokens", left))
