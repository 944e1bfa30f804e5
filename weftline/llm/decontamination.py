"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: every block of the table (about ``BLOCK_BYTES`` of text, whole documents) keeps
its own dictionary and position lists as one row of a staged table. Postings are therefore never shuffled, a very
common word is spread over all blocks, and a lost task only rebuilds its own blocks. Test windows are sent to the
blocks in chunks of at most ``CHUNK_WORDS`` words; a block looks a window up by its globally rarest term, shifts that
list by the term's place in the window and intersects it with the others, rarest first.

Words: A-Z to lower case, then runs of letters, digits and any character from U+0080. Null and empty texts have no
words. Repeated rows are kept apart; extra columns are not read. Without documents there are no rows; without items no
document is hit; items without an id hit words but are not listed.

Equal windows are searched once, however many items have them: a window carries the number of its set of items, and the
sets are joined to the documents at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import common
from weftline.llm.ragged import LETTER_OR_DIGIT, LOWER, Words, give_back, lists, ragged_index, text_slices

#: Text in one index block.
BLOCK_BYTES = 2_000_000
#: Text that is cut into words at once; a block is made of such slices.
SLICE_BYTES = 250_000
#: Places of windows' rarest terms that are looked into at once.
PLACES = 500_000
#: Window words sent to all tasks at once; 8 bytes each.
CHUNK_WORDS = 2_000_000
_PLACE = np.int64(32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged positional index of whole texts: (block, ids, n_words, terms, counts, places).

    A word's place is its number in the block plus the number of documents before it, so no phrase runs on from
    one document into the next. ``terms`` are sorted 64-bit word hashes, ``places`` ascend within each term.
    """
    common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("n_words", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
        ]
    )

    def row(block: int, ids: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        n, hashed = np.concatenate(counts), np.concatenate(hashes)
        order = np.argsort(hashed, kind="stable").astype(np.uint32)
        ordered = hashed[order]
        new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1))) if len(ordered) else order
        places = (np.arange(len(hashed), dtype=np.uint32) + np.repeat(np.arange(len(n), dtype=np.uint32), n))[order]
        bits = [ordered[new].tobytes(), np.diff(new, append=len(ordered)).astype(np.uint32).tobytes(), places.tobytes()]
        lists_ = [pa.array([ids], pa.list_(ids.type)), pa.array([n], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists_, *[pa.array([x], pa.binary()) for x in bits]], schema.names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a worker's tasks before this one have left
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            first, size, counts, hashes = 0, 0, [], []
            for _, hi, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                words = Words(LOWER[data], offsets, LETTER_OR_DIGIT)
                counts.append(words.counts().astype(np.int32))
                hashes.append(words.hash)
                size += len(data)
                if size >= BLOCK_BYTES or hi == batch.num_rows:
                    yield row(block, batch.column(0).slice(first, hi - first), counts, hashes)
                    block, first, size, counts, hashes = block + 1, hi, 0, [], []
        give_back()

    return common.stage(docs.select(id_col, text_col).mapInArrow(blocks, schema), "positional-index")


def test_windows(items: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms): each run of ``size`` words of an item, or all its words if they are fewer; ids as strings."""
    common.ready(items.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(LOWER[data], offsets, LETTER_OR_DIGIT)
                left = words.left()
                short = np.repeat(words.counts() < size, words.counts())
                head = np.zeros(len(words), bool)
                head[words.first[:-1][words.counts() > 0]] = True
                at = np.flatnonzero((left >= size) | (short & head))
                lengths = np.minimum(left[at], size)
                owner = np.searchsorted(words.first, at, "right") - 1 + lo
                terms = words.hash[ragged_index(at, lengths)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), lists(terms, lengths, pa.int64())], ["item", "terms"]
                )

    rows = items.select(F.col(id_col).cast("string").alias("item"), text_col)
    return rows.mapInArrow(windows, "item string, terms array<bigint>")


class _Chunk:
    """Windows as arrays: terms by their number in ``vocabulary``, and each window's places by rising term count."""

    def __init__(self, sets: np.ndarray, lengths: np.ndarray, terms: np.ndarray):
        self.sets, self.lengths = sets, lengths
        self.vocabulary, number = np.unique(terms.view(np.uint64), return_inverse=True)
        self.width = int(lengths.max())
        used = np.arange(self.width) < lengths[:, None]
        self.terms = np.full(used.shape, -1, np.int32)
        self.terms[used] = number
        self.order = np.zeros(used.shape, np.int16)

    def by_count(self, totals: dict[int, int]) -> _Chunk:
        count = np.array([totals.get(x, 0) for x in self.vocabulary.view(np.int64).tolist()], np.int64)
        rank = np.where(self.terms >= 0, count[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(rank, axis=1, kind="stable").astype(np.int16)
        return self

    def spans(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(window, first place, last place) of the windows' occurrences in one block, some windows at a time."""
        at = np.searchsorted(terms, self.vocabulary)
        here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == self.vocabulary) if len(terms) else at[:0]
        there = np.full(len(self.vocabulary), -1, np.int64)
        there[here] = np.arange(len(here))
        number = np.where(self.terms >= 0, there[self.terms], -2)
        window = np.flatnonzero((number != -1).all(axis=1))
        if not len(window):
            return
        begin = (np.cumsum(counts, dtype=np.int64) - counts)[at[here]]
        size = counts[at[here]].astype(np.int64)
        found = places[ragged_index(begin, size)].astype(np.int64)
        keys = (np.repeat(np.arange(len(here)), size) << _PLACE) | found
        start = np.cumsum(size) - size
        upto = np.cumsum(size[number[window, self.order[window, 0]]])
        cuts = np.searchsorted(upto, np.arange(PLACES, upto[-1], PLACES)) + 1
        for some in np.split(window, np.unique(cuts)):
            if len(some):
                yield self._occurrences(some, number, start, size, found, keys, slop)

    def _occurrences(self, window: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray, found: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
        place = self.order[window, 0].astype(np.int64)
        term = number[window, place]
        base = found[ragged_index(start[term], size[term])] - np.repeat(place, size[term])
        window = np.repeat(window, size[term])
        low = base + np.repeat(place, size[term])
        high = low.copy()
        for j in range(1, self.width):
            live = np.flatnonzero(j < self.lengths[window])
            place = self.order[window[live], j].astype(np.int64)
            term = number[window[live], place]
            least = np.maximum(base[live] + place - slop, 0) | (term << _PLACE)
            k = np.searchsorted(keys, least)
            got = keys[np.minimum(k, len(keys) - 1)]
            ok = (k < len(keys)) & (got <= ((base[live] + place + slop) | (term << _PLACE))) & (base[live] + place + slop >= 0)
            got &= (1 << 32) - 1
            low[live] = np.minimum(low[live], got)
            high[live] = np.maximum(high[live], got)
            keep = np.ones(len(window), bool)
            keep[live[~ok]] = False
            window, base, low, high = window[keep], base[keep], low[keep], high[keep]
        return window, low, high


def _chunks(windows: DataFrame) -> Iterator[_Chunk]:
    total = windows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = -(-total // CHUNK_WORDS)
    for c in range(n):
        part = windows.select("set", "terms").where(F.pmod(F.xxhash64("terms"), F.lit(n)) == c).toArrow()
        lengths = np.array([len(x) for x in part["terms"]], np.int64)
        if len(lengths):
            terms = part["terms"].combine_chunks().flatten().to_numpy()
            yield _Chunk(part["set"].to_numpy(), lengths, terms)


def window_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different windows as (set, terms) and their items as (set, items): windows of the same items share a set."""
    each = windows.distinct().groupBy("terms").agg(F.sort_array(F.collect_list("item")).alias("items"))
    each = common.stage(each, "windows")
    sets = common.stage(each.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "window-sets")
    return common.stage(each.join(sets, "items").select("set", "terms"), "windows"), sets


def _hits(first: np.ndarray, found: list[tuple[np.ndarray, ...]], sets: np.ndarray) -> tuple[np.ndarray, list, list]:
    """(documents, their window sets, their words hit) of the (window, low, high) found in a block."""
    edge = np.zeros(first[-1] + 1, np.int32)
    pairs = []
    for window, low, high in found:
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        doc = np.searchsorted(first, low, "right") - 1
        pairs.append(np.unique(np.stack([doc, sets[window]]), axis=1))
    doc, number = np.unique(np.concatenate(pairs, axis=1), axis=1)
    docs, at = np.unique(doc, return_index=True)
    hit = np.flatnonzero(np.cumsum(edge) > 0)
    of = np.searchsorted(first, hit, "right") - 1
    words = np.split(hit - first[of], np.searchsorted(of, docs[1:]))
    return docs, np.split(number, at[1:]), words


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Occurrences by document: (block, doc, sets, hit): the sets of the windows found and the numbers of the words hit.

    ``slop`` 0 finds exact phrases. With a larger one every term must stand within ``slop`` words of its place
    in the phrase (counted from the rarest term), all in one document; the words from the first to the last
    are then hit. A document has one row for each chunk of windows that occurs in it.
    """
    spark = common.ready(index.sparkSession)
    schema = "block bigint, doc int, sets array<bigint>, hit array<int>"
    parts = [spark.createDataFrame([], schema)]
    for chunk in _chunks(windows):
        vocabulary = spark.sparkContext.broadcast(chunk.vocabulary)

        def term_counts(batches, vocabulary=vocabulary):
            for batch in batches:
                for i in range(batch.num_rows):
                    terms, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((0, np.uint64), (1, np.uint32)))
                    at = np.searchsorted(terms, vocabulary.value)
                    ok = at < len(terms)
                    ok[ok] = terms[at[ok]] == vocabulary.value[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(vocabulary.value[ok].view(np.int64)), pa.array(counts[at[ok]].astype(np.int64))], ["term", "n"]
                    )

        counted = index.select("terms", "counts").mapInArrow(term_counts, "term bigint, n bigint")
        totals = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        sent = spark.sparkContext.broadcast(chunk.by_count(totals))

        def look_up(batches, sent=sent):
            for batch in batches:
                for i in range(batch.num_rows):
                    # views of the batch, no copies
                    terms, counts, places = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint64), (3, np.uint32), (4, np.uint32)))
                    first = np.append(0, np.cumsum(batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) + 1))
                    found = []
                    for window, low, high in sent.value.spans(terms, counts, places, slop):
                        same = high < first[np.searchsorted(first, low, "right")] - 1
                        if same.any():
                            found.append((window[same], low[same], high[same]))
                    if not found:
                        continue
                    docs, sets, words = _hits(first, found, sent.value.sets)
                    size = lambda x: np.array([len(v) for v in x], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(docs), batch.column(0)[i].as_py()), pa.int64()),
                            pa.array(docs, pa.int32()),
                            lists(np.concatenate(sets), size(sets), pa.int64()),
                            lists(np.concatenate(words), size(words), pa.int32()),
                        ],
                        ["block", "doc", "sets", "hit"],
                    )
            give_back()

        parts.append(index.select("block", "n_words", "terms", "counts", "places").mapInArrow(look_up, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _items(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, doc, items): the items of each document's window sets."""
    sent = sets.agg(F.coalesce(F.sum(F.size("items") * 40 + 40), F.lit(0))).first()[0] <= common.BROADCAST_BYTES
    each = found.select("block", "doc", F.explode("sets").alias("set")).distinct()
    each = each.join(F.broadcast(sets) if sent else sets, "set")
    return each.groupBy("block", "doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 13, slop: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: (its id, n_words, items, hit): ids of the test items found and the words hit."""
    index = build_index(docs, id_col, text_col)
    windows, sets = window_sets(test_windows(items, size))
    with common.small_batches(docs.sparkSession):
        found = common.stage(matches(index, windows, slop), "occurrences")
    hit = found.groupBy("block", "doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"))
    found = hit.join(_items(found, sets), ["block", "doc"])
    each = index.select("block", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("n_words").alias("n"))).alias("doc", "of"))
    return each.join(found, ["block", "doc"], "left").select(
        F.col("of.id").alias(id_col),
        F.col("of.n").cast("long").alias("n_words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The counts and the checksum of ``contamination``'s rows, and the verdict: a twentieth of the words or more."""
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents of which less than a twentieth of the words are hit."""
    keyed = docs.withColumn(common.ROW_KEY, common.row_key("doc_id", "text"))
    found = digest(contamination(keyed.select(F.col(common.ROW_KEY).alias("doc_id"), "text"), items))
    bad = common.stage(found.where("contaminated").select(F.col("doc_id").alias(common.ROW_KEY)).distinct(), "contaminated")
    return common.anti_join(keyed, bad, common.ROW_KEY).drop(common.ROW_KEY)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), p AS (
    SELECT item_id, least(len(w), 13) AS n, w[i : i + least(len(w), 13) - 1] AS win
    FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM p), s AS (
    SELECT r, i, n, w[i : i + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), m AS (SELECT r, i, s.n, item_id FROM s JOIN p ON s.win = p.win),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS t(k) GROUP BY r),
it AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
