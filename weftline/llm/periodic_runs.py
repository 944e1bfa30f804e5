"""Periodic runs of words in whole documents, and documents with each run cut back to one period.

A run of period q is a stretch of words in which words q apart are equal, as long as it can be made, of ``LEAST`` words and
of two periods at least, whose smallest period is q.

* Periods are searched by octave, P <= q < 2P. For each octave a document is laid out in tiles of ``12 P`` words (``TILE`` at
  least) and ``4 P`` more that the next tile has too. Any part of a run that is longer than two periods but does not fit the tile
  before lies whole in the next one or goes on beyond it, so every run is found in pieces that touch.
* In a tile, boundaries stand so densely that every run of the octave holds one where a word and the word q behind it are
  equal. Its Z-functions, forwards and backwards, say how far the words go on being equal for every q: zeros are dropped at
  once, the others found by bisection on prefix sums (two primes of 31 bits). Stretches that have a divisor of q as period
  are dropped.
* The pieces are shuffled by document and period and stitched where they touch. The runs go back to the documents.

The tiles of a document of up to ``LONG`` words are solved where its text is read; those of longer ones are staged as word
numbers and dealt to the tasks one by one, so a long document is many tasks' work. The result does not depend on it.

Words are runs of anything but white space, compared by 64-bit hashes. A null text has no words. Rows are told apart by id
and text (128 bits); equal rows have equal results, each its own. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import common
from weftline.llm.ragged import NOT_SPACE, Words, list_parts, packed, ragged_index, text_slices

LEAST = 12
#: Words of the smallest tiles.
TILE = 4096
#: Words of a document whose tiles are all solved in the task that reads it.
LONG = 1 << 20
SLICE = 1_000_000
#: Word pairs looked at together.
PAIRS = 2_000_000
#: Bytes of runs that are sent to every task; more are joined by a shuffle.
SENT_BYTES = 32_000_000

_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_245, 1_664_525_013)
_powers: dict[int, np.ndarray] = {}


def _power(prime: int, base: int, n: int) -> np.ndarray:
    """Powers 0 to n or more of ``base`` modulo ``prime``."""
    have = _powers.get(prime, np.ones(1, np.int64))
    while len(have) <= n:
        have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
    _powers[prime] = have
    return have


class _Equal:
    """Whether spans of a sequence are equal, by prefix sums modulo two primes."""

    def __init__(self, words: np.ndarray):
        self.sums = []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum((words % np.uint64(prime)).astype(np.int64) * _power(prime, base, len(words))[: len(words)] % prime, out=sums[1:])
            self.sums.append(sums)

    def __call__(self, lo: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` at ``lo`` and ``lo + shift`` are equal."""
        same = np.ones(len(lo), bool)
        for prime, base, sums in zip(_PRIMES, _BASES, self.sums, strict=True):
            a = (sums[lo + length] - sums[lo]) % prime * _power(prime, base, int(shift.max(initial=0)))[shift] % prime
            same &= a == (sums[lo + shift + length] - sums[lo + shift]) % prime
        return same

    def forwards(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on equal those ``shift`` behind, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self(at[open_], shift[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def backwards(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``at`` equal those ``shift`` behind, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self(at[open_] - middle, shift[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low


def _least_equal(period: np.ndarray) -> np.ndarray:
    """Words that equal those a period behind, in the shortest run of a period."""
    return np.maximum(LEAST, 2 * period) - period


def _factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to ``most``."""
    least = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if least[p] == p:
            at = np.arange(p * p, most + 1, p)
            least[at] = np.minimum(least[at], p)
    return least


def octaves(n: int) -> list[int]:
    """Octaves of the periods that a run in ``n`` words can have."""
    return [1 << k for k in range(max(n // 2, 1).bit_length())] if n >= LEAST else []


def tiles(n: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the tiles of texts of ``n`` words for periods of one octave."""
    fit = np.flatnonzero(n >= max(LEAST, 2 * octave))
    stride = max(12 * octave, TILE - 4 * octave)
    many = np.maximum(-(-(n[fit] - 4 * octave) // stride), 1)
    text = np.repeat(fit, many)
    first = ragged_index(np.zeros(len(fit), np.int64), many) * stride
    return text, first, np.minimum(first + stride + 4 * octave, n[text])


def solve(words: np.ndarray, equal: _Equal, first: np.ndarray, end: np.ndarray, octave: int) -> tuple[np.ndarray, ...]:
    """(tile, period, lo, hi) of the tiles [first, end): words lo to hi - 1 equal those a period behind; each stretch once."""
    periods = np.arange(octave, 2 * octave)
    step = int(_least_equal(periods).min())
    many = np.maximum(-(-(end - first - octave) // step), 0)
    tile = np.repeat(np.arange(len(first)), many)
    boundary = ragged_index(np.zeros(len(first), np.int64), many) * step + first[tile]
    found = []
    rows = max(1, PAIRS // octave)
    last = len(words) - 1
    for lo in range(0, len(boundary), rows):
        at, of = boundary[lo : lo + rows], tile[lo : lo + rows]
        ahead = at[:, None] + periods
        same = (words[at][:, None] == words[np.minimum(ahead, last)]) & (ahead < end[of][:, None])
        i, q = np.nonzero(same)
        at, of, q = at[i], of[i], periods[q]
        on = (at + q + 1 < end[of]) & (words[np.minimum(at + 1, last)] == words[np.minimum(at + q + 1, last)])
        on |= (at > first[of]) & (words[at - 1] == words[at + q - 1])
        found.append(np.stack([of[on], q[on], at[on]]))
    tile, q, at = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    low = at - equal.backwards(at, q, at - first[tile])
    high = at + equal.forwards(at, q, end[tile] - q - at)
    ok = high - low >= _least_equal(q)
    stretches = np.unique(np.stack([tile[ok], q[ok], low[ok], high[ok]]), axis=1)
    tile, q, low, high = stretches
    # with a smaller period, a stretch of two periods has one that divides q; the run is then found by that
    simple, left = np.ones(len(q), bool), q.copy()
    factor = _factors(2 * octave)
    while (more := np.flatnonzero(simple & (left > 1))).size:
        prime = factor[left[more]]
        divisor = q[more] // prime
        simple[more] = ~equal(low[more], divisor, high[more] + q[more] - divisor - low[more])
        left[more] //= prime
    return tile[simple], q[simple], low[simple], high[simple]


_KEY = "k1 bigint, k2 bigint"
_PIECE = f"{_KEY}, q bigint, lo bigint, hi bigint"
_STAGED = f"{_PIECE}, octave bigint, at bigint, words binary"


def _batch(keys: list, q, lo, hi, tile: tuple = ()) -> pa.RecordBatch:
    n = len(keys[0])
    columns = [*keys, *[pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64()) for x in (q, lo, hi)]]
    columns += tile or [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STAGED.split(", ")])


def pieces(rows: DataFrame, long: int) -> DataFrame:
    """(k1, k2, q, lo, hi) of rows (k1, k2, text): the stretches found in all tiles."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in text_slices(batch.column(2), SLICE):
                words = Words(data, offsets, NOT_SPACE)
                n, start = words.counts(), words.first[:-1]
                keys = lambda at, row=row: [batch.column(c).take(pa.array(row + at)) for c in (0, 1)]
                short = np.where(n <= long, n, 0)
                equal = _Equal(words.hash) if short.any() else None
                for octave in octaves(int(short.max(initial=0))):
                    text, first, end = tiles(short, octave)
                    tile, q, lo, hi = solve(words.hash, equal, first + start[text], end + start[text], octave)
                    if len(tile):
                        text = text[tile]
                        yield _batch(keys(text), q, lo - start[text], hi - start[text])
                for text in np.flatnonzero(n > long).tolist():
                    number = np.unique(words.hash[start[text] : start[text] + n[text]], return_inverse=True)[1].astype(np.int32)
                    for octave in octaves(int(n[text])):
                        _, first, end = tiles(n[text : text + 1], octave)
                        for a, b in zip(first.tolist(), end.tolist(), strict=True):
                            tile = [pa.array([octave]), pa.array([a]), pa.array([number[a:b].tobytes()], pa.binary())]
                            yield _batch(keys(np.array([text])), None, None, None, tile)

    def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column(4)[i].as_py(), np.int32).astype(np.uint64)
                octave, at = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                tile, q, lo, hi = solve(words, _Equal(words + np.uint64(1)), np.zeros(1, np.int64), np.array([len(words)]), octave)
                key = [batch.column(c).take(pa.array(np.full(len(tile), i))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(q), pa.array(lo + at), pa.array(hi + at)], ["k1", "k2", "q", "lo", "hi"])

    staged = common.stage(rows.mapInArrow(explode, _STAGED), "run-tiles")
    dealt = staged.where("words IS NOT NULL").select("k1", "k2", "octave", "at", "words").repartition("k1", "k2", "octave", "at")
    return staged.where("words IS NULL").select("k1", "k2", "q", "lo", "hi").unionByName(dealt.mapInArrow(solve_tiles, _PIECE))


def stitched(found: DataFrame) -> DataFrame:
    """(k1, k2, runs): pieces that touch joined; runs as structs (start, period, length) in that order."""
    found = found.distinct()  # overlapping tiles and equal rows find the same; combined before the shuffle
    by = Window.partitionBy("k1", "k2", "q").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    found = found.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = found.groupBy("k1", "k2", "q", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") + F.col("q") - F.col("start")
    runs = whole.select("k1", "k2", "start", "q", length.alias("length")).groupBy("k1", "k2", "start", "length").agg(F.min("q").alias("period"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def row_keys(*columns: Column) -> list[Column]:
    """Two 64-bit keys of a row's values, independent of each other."""
    values = [c for column in columns for c in (column, column.isNull())]
    return [F.xxhash64(*values).alias("k1"), F.xxhash64(F.lit("second"), *values).alias("k2")]


def _joined(rows: DataFrame, runs: DataFrame) -> DataFrame:
    runs = common.stage(runs, "runs")
    size = runs.agg(F.coalesce(F.sum(24 * F.size("runs") + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(runs) if size <= SENT_BYTES else runs, ["k1", "k2"], "left")


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """(id, n_words, runs, text) of each row: its runs, and its words without those that repeat a run's first period."""
    common.ready(docs.sparkSession)
    rows = docs.select(*row_keys(F.col(id_col), F.col(text_col)), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stitched(pieces(rows.select("k1", "k2", "text"), long))
    joined = _joined(rows, found).select("id", "text", F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"))
    flat = F.flatten(F.transform("runs", lambda r: F.array(r["start"] + r["period"], r["start"] + r["length"]))).alias("spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, sizes = list_parts(batch.column(3))
            ends = np.append(0, np.cumsum(sizes))
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                edge = np.zeros(len(words) + 1, np.int64)
                span = spans[ends[lo] : ends[hi]] + np.repeat(words.first[:-1], sizes[lo:hi])
                np.add.at(edge, span[::2], 1)
                np.add.at(edge, span[1::2], -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                # each kept word with one byte more, which becomes the space behind it
                size = words.end[keep] - words.start[keep] + 1
                text = np.append(data, np.uint8(0x20))[ragged_index(words.start[keep], size)]
                text[np.cumsum(size) - 1] = 0x20
                first = np.append(0, np.cumsum(size))[np.searchsorted(keep, words.first)]
                behind = np.diff(first) > 0  # no space behind a text's last word
                stay = np.ones(len(text), bool)
                stay[first[1:][behind] - 1] = False
                bytes_ = packed(text[stay], np.diff(first) - behind)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(words.counts()), batch.column(2).slice(lo, hi - lo), bytes_.view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,period:bigint,length:bigint>>, text string"
    return joined.select("id", "text", "runs", flat).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each row and checksums of ``collapse_runs``'s results."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("longest", longest)
    length = -F.col("longest.length")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-longest.length * 1000) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the query's contract sets it: one document in ten by hash repeats a stretch of its own to its end."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))
    # words and numbers are bound to names once, so that the long array is not made again for every word
    again = """get(transform(array(w), w -> array_join(get(transform(array((h div 10) % size(w)), a -> get(transform(
        array(1 + (size(w) - a) div (3 + (h div 10) % 8)), p -> transform(w, (x, i) -> IF(i < a, x, get(w, int(a + (i - a) % p))))), 0)), 0), ' ')), 0)"""
    changed = rows.where("h % 10 = 0").withColumn("w", words).selectExpr("doc_id", f"IF(size(w) > 0, {again}, '') AS text")
    return rows.where("h IS NULL OR h % 10 <> 0").select("doc_id", "text").unionByName(changed)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(collapse_runs(with_periods(common.table(spark, sf_dir, "documents"))))


OP12_SQL = r"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
), h AS (
    SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
           lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295) AS h
    FROM documents, crc_table WHERE doc_id IS NOT NULL
), raw AS (
    SELECT row_number() OVER () AS r, d.doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d LEFT JOIN h USING (doc_id)
), cut AS (SELECT *, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM raw),
per AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM cut),
d AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM per),
pos AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
pair AS (SELECT a.r, b.i - a.i AS q, a.i FROM pos a JOIN pos b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
island AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair) GROUP BY r, q, g),
run AS (SELECT r, s, len, min(q) AS q FROM island WHERE len >= greatest(12, 2 * q) GROUP BY r, s, len),
gone AS (SELECT DISTINCT r, i FROM run, unnest(range(s + q, s + len)) AS t(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (SELECT r, s, len, q FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY len DESC, s, q) = 1),
lines AS (SELECT r, count(*) AS n, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r)
SELECT doc_id, coalesce(lines.n, 0)::BIGINT AS n_runs, s::BIGINT AS start, best.len::BIGINT AS length, q::BIGINT AS period, (1000 * best.len // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
