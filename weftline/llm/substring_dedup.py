"""Substring de-duplication: words covered by a window that also starts elsewhere, found with sharded FM-indexes.

1. Every window of ``size`` words is dealt by its minimizer (the ``GRAM``-word run in it with the lowest hash).
   Neighbouring windows with one minimizer make a segment; equal windows always meet under one minimizer, and
   each window belongs to one segment. Segments are staged as places and hashes, without words.
2. A minimizer that occurs once cannot belong to a repeated window and is dropped. Equal segments are counted
   map-side and kept once. A minimizer with more than ``most`` different segments (the border of a passage that
   very many documents share) is dealt again by the hash of each window, so no shard grows with it.
3. A shard of some ``SHARD_WORDS`` words becomes a compressed FM-index: bit-packed wavelet matrix over the word
   ids of its Burrows-Wheeler transform. Its segments are streamed through it, from their last word to the
   first, by backward search; matching statistics are held at ``size`` words. An interval of two or more
   occurrences (copies of a segment counted) is reported, and comes back to every place of the segment.

Words are runs of characters other than ASCII white space, compared by 64-bit hashes. Null and empty texts have
none. Equal rows count as different documents. Other columns come back unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.ragged import NOT_SPACE, SpanHasher, Words, gram_hashes, list_parts, lists, ragged_index, text_slices

#: Words in a minimizer.
GRAM = 8
#: Words in an index shard, roughly.
SHARD_WORDS = 1_500_000
#: Different segments of one minimizer that one shard takes.
MOST_SEGMENTS = 30_000

SEGMENT = "row_key bigint, at int, n int, anchor bigint, segment bigint"


def _segments(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, minimizer hash, segment hash) of all segments."""
    grams = gram_hashes(words.hash, GRAM)
    last = len(words) - size + 1
    none = np.zeros(0, np.int64)
    if last <= 0:
        return none, none, none, none
    # the lowest hash wins and, among equal ones, the leftmost: both follow from the window's words alone
    low = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span, reach = size - GRAM + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: last], low[span - reach : span - reach + last])
    place = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    window = np.flatnonzero(words.left()[:last] >= size)
    if not len(window):
        return none, none, none, none
    place = place[window]
    head = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    n = np.diff(head, append=len(window))
    at = window[head]
    return at, n, grams[place[head]], SpanHasher(words.hash)(at, at + n + size - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _find_segments(size: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                at, n, anchor, segment = _segments(words, size)
                doc = np.searchsorted(words.first, at, "right") - 1
                columns = [pa.array(keys[lo + doc]), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, _signed(anchor), _signed(segment)], ["row_key", "at", "n", "anchor", "segment"])

    return run


def _cut_windows(size: int):
    """Segments of very common minimizers as single windows, dealt by their own hash."""

    def run(batches):
        for batch in batches:
            at, n = list_parts(batch.column(2))[0].astype(np.int64), list_parts(batch.column(3))[0].astype(np.int64)
            per_row = list_parts(batch.column(2))[1]
            row = np.repeat(np.arange(batch.num_rows), per_row)
            keys = batch.column(0).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                mine = (row >= lo) & (row < hi)
                lengths = n[mine]
                doc = np.repeat(row[mine] - lo, lengths)
                first = ragged_index(at[mine], lengths)
                place = words.first[doc] + first
                whole = _signed(SpanHasher(words.hash)(place, place + size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo + doc]), pa.array(first.astype(np.int32)), pa.array(np.ones(len(doc), np.int32)), whole, whole],
                    ["row_key", "at", "n", "anchor", "segment"],
                )

    return run


def _take_words(size: int):
    """The words of chosen segments: (shard, segment, copies, words)."""

    def run(batches):
        for batch in batches:
            at, per_row = list_parts(batch.column(2))
            n, shard, segment, copies = (list_parts(batch.column(i))[0] for i in range(3, 7))
            row = np.repeat(np.arange(batch.num_rows), per_row)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                mine = (row >= lo) & (row < hi)
                lengths = n[mine].astype(np.int64) + size - 1
                place = words.first[row[mine] - lo] + at[mine]
                taken = words.hash[ragged_index(place, lengths)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[mine]), pa.array(segment[mine]), pa.array(copies[mine]), lists(taken, lengths, pa.int64())],
                    ["shard", "segment", "copies", "words"],
                )

    return run


class WaveletMatrix:
    """Rank over a sequence of small integers in about one bit a level: packed bits and a count per 64."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        left = symbols.astype(np.uint32)
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = ((left >> np.uint32(bit)) & np.uint32(1)).astype(bool)
            packed = np.zeros(len(left) // 64 + 1, np.uint64)
            bits = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(bits)] = bits
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((bit, packed, before, int(len(left) - ones.sum())))
            left = np.concatenate([left[~ones], left[ones]])

    def map(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` goes when only ``symbols`` are followed down; differences of this are ranks."""
        place = place.astype(np.int64)
        for bit, packed, before, zeros in self.levels:
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            place = np.where((symbols >> bit) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """An FM-index of weighted texts of 64-bit words, for patterns of up to ``size`` words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, copies: np.ndarray, size: int):
        total = int(lengths.sum()) + len(lengths) + 1
        self.start = np.cumsum(lengths + 1) - lengths  # a separator, symbol 0, stands before each text and at the end
        symbols = np.zeros(total, np.int64)
        places = ragged_index(self.start, lengths)
        names, symbols[places] = np.unique(words, return_inverse=True)
        symbols[places] += 1
        self.symbols, self.size = symbols, size
        # suffixes in order of their first 64 words or more: all that patterns of ``size`` words can tell apart
        rank, depth = symbols, 1
        while depth <= size:
            if 2 * depth > size >= depth:
                short = rank
                gap = size - depth
            key = rank * (total + 1)
            key[:-depth] += rank[depth:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            depth *= 2
        shifted = np.zeros(total, np.int64)
        shifted[: total - gap] = short[gap:]
        same = np.zeros(total, bool)
        same[1:] = (short[order[1:]] == short[order[:-1]]) & (shifted[order[1:]] == shifted[order[:-1]])
        heads = np.flatnonzero(~same)
        self.block = (np.cumsum(~same) - 1).astype(np.int32)
        self.heads = np.append(heads, total)
        weight = np.zeros(total, np.int64)
        weight[places] = np.repeat(copies, lengths)
        self.weight = np.zeros(total + 1, np.int64)
        np.cumsum(weight[order], out=self.weight[1:])
        self.matrix = WaveletMatrix(symbols[order - 1], len(names))
        every = np.arange(len(names) + 1)
        first = np.cumsum(np.bincount(symbols, minlength=len(every))) - np.bincount(symbols, minlength=len(every))
        self.base = first - self.matrix.map(every, np.zeros(len(every), np.int64))

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one word: the rows of ``symbol`` + pattern from those of the pattern."""
        both = self.matrix.map(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.base[symbols] + both[: len(symbols)], self.base[symbols] + both[len(symbols) :]

    def occurrences(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, occurrences) of every window of the indexed texts, streamed through the index."""
        text = np.flatnonzero(lengths >= self.size)
        low, high = np.zeros(len(text), np.int64), np.full(len(text), len(self.symbols), np.int64)
        end = self.start[text] + lengths[text]
        out = []
        for t in range(1, int(lengths.max(initial=0)) + 1):
            live = t <= lengths[text]
            if not live.all():
                text, low, high, end = text[live], low[live], high[live], end[live]
            if not len(text):
                break
            low, high = self.step(self.symbols[end - t], low, high)
            if t >= self.size:
                if t > self.size:  # back from size + 1 words to the interval of the first ``size``
                    low = self.heads[self.block[low]]
                    high = self.heads[self.block[low] + 1]
                out.append((text, lengths[text] - t, self.weight[high] - self.weight[low]))
        if not out:
            return text, text, text
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(size: int):
    def run(part):
        words, lengths = list_parts(part["words"])
        lengths = lengths.astype(np.int64)
        index = FMIndex(words, lengths, part["copies"].to_numpy(), size)
        text, at, seen = index.occurrences(lengths)
        text, at = text[seen > 1], at[seen > 1]
        order = np.lexsort((at, text))
        text, at = text[order], at[order]
        head = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        tail = np.append(head[1:], len(text))[: len(head)] - 1
        return pa.table({"segment": part["segment"].combine_chunks().take(pa.array(text[head])), "lo": at[head].astype(np.int32), "hi": (at[tail] + size).astype(np.int32)})

    return run


def repeated_spans(docs: DataFrame, size: int = 35, most: int = MOST_SEGMENTS, text_col: str = "text") -> DataFrame:
    """(row_key, spans): for rows of (row_key, text), the word spans [lo, hi) made of windows that occur twice or more."""
    if size < GRAM:
        raise ValueError(f"windows need {GRAM} words or more")
    spark = common.ready(docs.sparkSession)
    keyed = docs.select("row_key", text_col)
    segments = common.stage(keyed.mapInArrow(_find_segments(size), SEGMENT), "segments")

    def shared(rows: DataFrame) -> DataFrame:
        again = rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
        return rows.join(again, "anchor", "left_semi").select("row_key", "at", "n", "anchor", "segment")

    found = common.stage(shared(segments), "shared-segments")
    once = ["anchor", "segment", "n"]

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*once).agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "at")).alias("of"))

    hot = common.stage(distinct(found).groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > most).select("anchor"), "common-anchors")
    if not hot.isEmpty():
        places = found.join(hot, "anchor", "left_semi").groupBy("row_key").agg(F.collect_list(F.struct("at", "n")).alias("s"))
        cut = keyed.join(places, "row_key").select("row_key", text_col, "s.at", "s.n").mapInArrow(_cut_windows(size), SEGMENT)
        # equal rows have one key: their windows come once for each of them and each time they were collected
        cut = shared(common.stage(cut, "windows"))
        found = common.stage(found.join(hot, "anchor", "left_anti").select(*cut.columns).unionByName(cut), "shared-segments")
    chosen = common.stage(distinct(found).select(*once, "copies", "of.row_key", "of.at"), "distinct-segments")
    total = chosen.agg(F.sum(F.col("n") + size - 1)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    wanted = chosen.groupBy("row_key").agg(F.collect_list(F.struct("at", "n", F.pmod("anchor", F.lit(shards)).alias("shard"), "segment", "copies")).alias("s"))
    texts = keyed.dropDuplicates(["row_key"]).join(wanted, "row_key")
    taken = texts.select("row_key", text_col, "s.at", "s.n", "s.shard", "s.segment", "s.copies").mapInArrow(
        _take_words(size), "shard bigint, segment bigint, copies bigint, words array<bigint>"
    )
    hits = taken.groupBy("shard").applyInArrow(_search(size), "segment bigint, lo int, hi int")
    return (
        found.join(hits, "segment")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set(F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))).alias("spans"))
    )


def remove_repeats(docs: DataFrame, size: int = 35, most: int = MOST_SEGMENTS, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, the word spans to remove (null where there are none); rows are told apart by keys and text."""
    keyed = docs.withColumn(common.ROW_KEY, common.row_key(*keys, text_col))
    spans = repeated_spans(keyed.select(F.col(common.ROW_KEY).alias("row_key"), F.col(text_col).alias("text")), size, most)
    return keyed.join(spans.withColumnRenamed("row_key", common.ROW_KEY), common.ROW_KEY, "left").drop(common.ROW_KEY)


def _digest(batches):
    for batch in batches:
        n_words, n_removed, kept_hash = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            removed = np.zeros(len(words) + 1, np.int64)
            for span in spans or ():
                removed[span["lo"]] += 1
                removed[span["hi"]] -= 1
            gone = np.cumsum(removed)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words
            kept_hash.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_hash)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(marked: DataFrame) -> DataFrame:
    """Counts and the checksum of the kept words of ``remove_repeats``' rows."""
    return marked.select("doc_id", "text", "spans").mapInArrow(_digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


OP1_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT r, i, array_to_string(w[i : i + 34], ' ') AS t FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35
), again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN again USING (t), unnest(range(0, 35)) AS u(k)),
word AS (SELECT r, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
