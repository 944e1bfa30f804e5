"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Counts of five-byte grams come from all trusted documents (label 1) but every ``HELD_OUT``-th, pre-aggregated in each task
and summed by gram. Lower orders count different left neighbours; discounts come from counts of counts, and each order's
probabilities are joined with its context sums and with the next lower order, sharded by gram. The model is cut
by its contexts into blocks of at most ``BLOCK_ROWS`` rows, so a position of a text needs one block only; blocks are
sent to the tasks one after the other and a document's sums over blocks are added up.

A document's score is its mean surprise in nats a byte, drawn towards its language's mean as ``SHRINK`` bytes of
average text would. Each language's threshold is the ``HIGH`` quantile of its held-out trusted scores. Where they are too few
to have one below their maximum, it is that maximum, or what ``HIGH`` of further scores of their mean and spread stay below if
that is more. Null and empty texts score the mean and stay. Languages (null is one) with fewer than two held-out documents
take the overall threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.ragged import text_slices, tidy

ORDER = 5
HELD_OUT = 5
BLOCK_ROWS = 3_000_000
SHRINK = 100
#: The quantile of held-out trusted scores that is a language's threshold, and the same of a normal distribution.
HIGH, NORMAL_HIGH = 0.995, 2.5758

_MASK = [(1 << (8 * k)) - 1 for k in range(ORDER + 1)]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the gram that it ends, as one integer; zero bytes stand before a text."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER - 1, -1, -1):
        out <<= 8
        out[k:] += np.where(place[k:] >= k, data[: max(0, len(data) - k)], 0)
    return out


def gram_counts(texts: DataFrame) -> DataFrame:
    """(g, c): how often each gram ends at a byte of the texts."""

    @tidy
    def count(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                k, c = np.unique(grams(data, offsets), return_counts=True)
                keys, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, c])).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])

    return texts.mapInArrow(count, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and from 3 on."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]


def train(trusted: DataFrame) -> DataFrame:
    """The staged model: (k, g, p, gamma). Rows with ``p`` are grams of k bytes, rows with ``gamma`` contexts of k - 1."""
    spark = common.ready(trusted.sparkSession)
    counts = [None] * (ORDER + 1)
    counts[ORDER] = common.stage(gram_counts(trusted), "grams")
    for k in range(ORDER - 1, 0, -1):
        lower = counts[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(_MASK[k])).alias("g")).agg(F.count("*").alias("c"))
        counts[k] = common.stage(lower, "grams")
    model = spark.createDataFrame([], "k int, g bigint, p double, gamma double")
    below = None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("g", "c", F.shiftright("g", 8).alias("h"), discount.alias("d"))
        sums = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = rows.join(sums, "h")
        if below is None:
            p = F.lit(1 / 256)
        else:
            rows = rows.withColumn("low", F.col("g").bitwiseAND(F.lit(_MASK[k - 1]))).join(below, "low")
            p = F.col("lower")
        rows = common.stage(rows.select("g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * p).alias("p")), "model-grams")
        below = rows.select(F.col("g").alias("low"), F.col("p").alias("lower"))
        model = model.unionByName(rows.select(F.lit(k).alias("k"), "g", "p", F.lit(None).cast("double").alias("gamma")))
        model = model.unionByName(sums.select(F.lit(k).alias("k"), F.col("h").alias("g"), F.lit(None).cast("double").alias("p"), "gamma"))
    return common.stage(model, "model")


class Block:
    """A block of the model as sorted arrays, for the positions whose two bytes of context belong to it."""

    def __init__(self, rows: pa.Table, number: int, blocks: int):
        self.number, self.blocks, self.tables = number, blocks, {}
        k, g, p, gamma = (rows[c].to_numpy() for c in ("k", "g", "p", "gamma"))
        for level in range(1, ORDER + 1):
            for kind, values in (("p", p), ("gamma", gamma)):
                mine = (k == level) & ~np.isnan(values)
                order = np.argsort(g[mine])
                self.tables[level, kind] = g[mine][order], values[mine][order]

    def _find(self, level: int, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[level, kind]
        if not len(known):
            return np.zeros(len(keys), bool), np.ones(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, values[at]

    def surprise(self, keys: np.ndarray) -> np.ndarray:
        """-log p of the last byte of each gram after the bytes before it."""
        p = np.full(len(keys), 1 / 256)
        for level in range(1, ORDER + 1):
            key = keys & _MASK[level]
            seen, own = self._find(level, "p", key)
            known, gamma = self._find(level, "gamma", key >> 8)
            p = np.where(seen, own, np.where(known, gamma, 1.0) * p)
        return -np.log(p)

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> 8) & 0xFFFF) % self.blocks == self.number


def _blocks(model: DataFrame):
    n = max(1, -(-model.count() // BLOCK_ROWS))
    context = F.when(F.col("p").isNotNull(), F.shiftright("g", 8)).otherwise(F.col("g")).bitwiseAND(F.lit(0xFFFF))
    for b in range(n):
        yield Block(model.where((F.col("k") <= 2) | (context % n == b)).toArrow(), b, n)


def _score(sent):
    @tidy
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                keys = grams(data, offsets)
                row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                if sent.value.blocks > 1:
                    mine = sent.value.mine(keys)
                    keys, row = keys[mine], row[mine]
                once, where = np.unique(keys, return_inverse=True)
                total = np.bincount(row, sent.value.surprise(once)[where], hi - lo).astype(np.float64)
                n = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total), pa.array(n)], [common.ROW_KEY, "total", "n"])

    return run


def scores(keyed: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, total, n): surprise and bytes of each text; equal rows have one key, one row and the same mean."""
    parts = None
    for block in _blocks(model):
        sent = keyed.sparkSession.sparkContext.broadcast(block)
        part = keyed.select(common.ROW_KEY, text_col).mapInArrow(_score(sent), f"{common.ROW_KEY} bigint, total double, n bigint")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(common.ROW_KEY).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row key, id, lang, n_bytes, perplexity, score, threshold, rejected), a row for each row of ``docs``."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(common.semi_join(mine, trusted.where(~fold), "doc_id", 8).select("text"))
    keyed = mine.withColumn(common.ROW_KEY, common.row_key("doc_id", "text", "lang"))
    rows = keyed.drop("text").join(scores(keyed, model), common.ROW_KEY).select(common.ROW_KEY, "doc_id", "lang", "total", "n")
    rows = common.stage(rows, "surprise")
    held = common.semi_join(rows.where("n > 0"), trusted.where(fold), "doc_id", 8)
    own = held.groupBy(F.col("lang").alias("of")).agg((F.sum("total") / F.sum("n")).alias("mean"))
    overall = held.agg((F.sum("total") / F.sum("n")).alias("mean")).first()["mean"] or 0.0

    def drawn(mean: Column) -> Column:
        return (F.col("total") + SHRINK * mean) / (F.col("n") + SHRINK)

    def limit(score: Column) -> Column:
        n, z = F.count(score), NORMAL_HIGH
        free = n - 1
        student = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)
        further = F.avg(score) + student * F.stddev_samp(score) * F.sqrt(1 + 1 / n)
        few = F.when(n > 1, F.greatest(F.max(score), further))
        return F.when(n * (1 - HIGH) >= 1, F.percentile_approx(score, HIGH, 10_000)).otherwise(few)

    own = held.join(own, F.col("lang").eqNullSafe(F.col("of"))).select("of", "mean", drawn(F.col("mean")).alias("score"))
    own = own.groupBy("of").agg(F.first("mean").alias("mean"), limit(F.col("score")).alias("threshold"))
    fallback = held.agg(limit(drawn(F.lit(overall))).alias("t")).first()["t"]
    placed = rows.join(own, F.col("lang").eqNullSafe(F.col("of")), "left")
    score = drawn(F.coalesce("mean", F.lit(overall)))
    threshold = F.coalesce("threshold", F.lit(fallback).cast("double"))
    return placed.select(
        common.ROW_KEY,
        "doc_id",
        "lang",
        F.col("n").alias("n_bytes"),
        F.exp(F.col("total") / F.greatest("n", F.lit(1))).alias("perplexity"),
        score.alias("score"),
        threshold.alias("threshold"),
        F.coalesce(score > threshold, F.lit(False)).alias("rejected"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``classify`` does not reject."""
    bad = common.stage(classify(docs, labels).where("rejected").select(common.ROW_KEY).distinct(), "rejected")
    keyed = docs.withColumn(common.ROW_KEY, common.row_key("doc_id", "text", "lang"))
    return common.anti_join(keyed, bad, common.ROW_KEY).drop(common.ROW_KEY)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop(common.ROW_KEY)
