"""Near-duplicate documents by BagMinHash signatures over five-word shingles counted with their repeats.

Signature: every unit of a shingle's weight is a Poisson process of rate 1 whose points fall on ``SLOTS`` slots;
a slot keeps its earliest point. Weights are split into dyadic ranges, each a process of its own that is halved
only when it has a point, so a shingle that occurs thousands of times costs what its earliest points cost. The
chance that a slot agrees is exactly the weighted Jaccard similarity of the two documents.

Banding: ``SLOTS`` / ``ROWS`` bands of ``ROWS`` slots. At a similarity of 0.8 a pair misses every band with
probability (1 - 0.8^4)^24 = 3e-6. Documents that share a bucket belong to a family (buckets become stars, their
components the families). A family of more than ``BLOCK`` members, as texts make that have little but a template in common, is
first split by prefixes: of two texts at 0.8 or more each has at most a fifth of its shingles outside the other, so
in one order of all shingles their first fifths (and one more) share a shingle. The order puts shingles that are frequent in
the family last, so that a template is in no prefix; what shares no prefix is apart, and no link is lost.
Within a family all members are then compared exactly, on multisets of shingles, by matrix
products inside tasks; one that is still large is dealt into blocks of about ``BLOCK`` members and a group of rows holds two of them.
Tasks return only a spanning forest of the links found, so results stay linear in the number of
documents. Exact copies are one member.

Words are runs of characters other than ASCII white space. A text of fewer than five words is one shingle; null
and word-less texts are alone. Rows that share a ``doc_id`` and a text are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import components
from weftline.llm.ragged import NOT_SPACE, Words, gram_hashes, lists, mix, powers, ragged_index, text_slices, tidy

SHINGLE = 5
SLOTS = 96
ROWS = 4
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
#: Members of a family that one group compares with each other, or with as many others.
BLOCK = 1500
#: A shingle that one of so many members of a family has is frequent there. It decides the order in prefixes, not what is found.
FREQUENT = 16

_NEXT = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD1B54A32D192ED03)
_SIDE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, in text order."""
    left, counts = words.left(), words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    hashes = np.zeros(len(words), np.uint64)
    whole = gram_hashes(words.hash, SHINGLE)
    hashes[: len(whole)] = whole
    full = left >= SHINGLE
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = words.first[short]
        n = counts[short]
        step = powers(SHINGLE)[ragged_index(np.zeros(len(n), np.int64), n)]
        flat = words.hash[ragged_index(first, n)] * step
        hashes[first] = mix(np.add.reduceat(flat, np.cumsum(n) - n) + n.astype(np.uint64))
        full[first] = True
    return text[full], hashes[full]


def _waits(seed: np.ndarray) -> np.ndarray:
    return -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def bag_minhash(text: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_texts x slots, ids of the earliest points) of weighted sets; texts without members stay zero."""
    total = np.bincount(text, weight, n_texts)
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)  # dyadic ranges [0,1), [1,2), [2,4), ... up to the weight
    level = ragged_index(np.zeros(len(levels), np.int64), levels)
    text, cap = np.repeat(text, levels), np.repeat(weight, levels)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = mix(np.repeat(gram, levels) + mix(level.astype(np.uint64) + np.uint64(1)))
    time = _waits(seed) / width
    earliest = np.full(n_texts * slots, np.inf)
    point = np.zeros(n_texts * slots, np.uint64)
    has = total > 0
    bound = np.zeros(n_texts)
    bound[has] = slots * (np.log(slots) + 3) / total[has]
    while True:
        waiting = []
        while len(time):
            due = time <= bound[text]
            if not due.all():
                waiting.append((text[~due], cap[~due], low[~due], width[~due], seed[~due], time[~due]))
                text, cap, low, width, seed, time = (x[due] for x in (text, cap, low, width, seed, time))
            unit = width == 1
            at = text[unit] * slots + (mix(seed[unit] ^ _SLOT) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(earliest, at, time[unit])
            won = time[unit] == earliest[at]
            point[at[won]] = seed[unit][won]
            after = mix(seed[unit] + _NEXT)
            parts = [(text[unit], cap[unit], low[unit], width[unit], after, time[unit] + _waits(after))]
            if not unit.all():
                # the point falls into one half of its range; the other half's process starts anew from here
                t, c, lo, w, s, now = (x[~unit] for x in (text, cap, low, width, seed, time))
                half = w // 2
                side = (mix(s ^ _SIDE[0]) & np.uint64(1)).astype(np.int64)
                inner, outer = mix(s + _SIDE[side]), mix(s + _SIDE[1 - side])
                parts.append((t, c, lo + side * half, half, inner, now))
                parts.append((t, c, lo + (1 - side) * half, half, outer, now + _waits(outer) / half))
            text, cap, low, width, seed, time = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1:
                inside = low < cap
                text, cap, low, width, seed, time = (x[inside] for x in (text, cap, low, width, seed, time))
        unfilled = has & np.isinf(earliest.reshape(n_texts, slots)).any(axis=1)
        if not unfilled.any():
            return point.reshape(n_texts, slots)
        bound[unfilled] *= 2
        text, cap, low, width, seed, time = (np.concatenate(x) for x in zip(*waiting, strict=True))
        again = unfilled[text]
        text, cap, low, width, seed, time = (x[again] for x in (text, cap, low, width, seed, time))


def weighted(text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of the different shingles of each text."""
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    head = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(gram, prepend=gram[:1] ^ np.uint64(1)) != 0)) if len(text) else order
    return text[head], gram[head], np.diff(head, append=len(text))


@tidy
def _bands(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            words = Words(data, offsets, NOT_SPACE)
            ids = bag_minhash(*weighted(*shingles(words)), hi - lo)
            n_bands = SLOTS // ROWS
            keys = np.repeat(np.arange(n_bands, dtype=np.uint64)[None, :], hi - lo, axis=0)
            for j in range(ROWS):
                keys += ids[:, j::ROWS] * powers(ROWS + 1)[j + 1]
            any_word = words.counts() > 0
            column = lists(mix(keys[any_word].ravel()).view(np.int64), np.where(any_word, n_bands, 0), pa.int64())
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), column], ["doc_id", "node", "bands"])


@tidy
def _members(batches):
    """The shingles of whole texts as sorted keys, the k-th copy of a shingle with a key of its own."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            text, gram, times = weighted(*shingles(Words(data, offsets, NOT_SPACE)))
            copy = ragged_index(np.zeros(len(times), np.int64), times).astype(np.uint64)
            text, keys = np.repeat(text, times), mix(np.repeat(gram, times) + copy * _NEXT)
            keys = keys[np.lexsort((keys, text))]
            edge = np.searchsorted(text, np.arange(hi - lo + 1))
            members = [keys[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(members, pa.binary())], ["node", "members"])


def similar_pairs(rows: np.ndarray, keys: np.ndarray, n: int, split: int) -> np.ndarray:
    """Which of ``n`` key sets, given as (row, key), are similar: an n x n matrix, only rows below ``split`` against the rest if it is set.

    Intersections are a product of 0/1 matrices, a stretch of the shared keys at a time.
    """
    size = np.bincount(rows, minlength=n)
    _, column, often = np.unique(keys, return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    rows, column = rows[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    left, right = (split, n - split) if split else (n, n)
    both = np.zeros((left, right), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        x = np.zeros((n, 2048), np.float32)
        x[rows[lo:hi], column[lo:hi] - start] = 1
        both += (x[:split] @ x[split:].T) if split else (x @ x.T)
    union = (size[:left, None] + (size[None, split:] if split else size[None, :])) - both
    return SIMILAR[1] * both >= SIMILAR[0] * union


def joined(linked: np.ndarray, split: int) -> np.ndarray:
    """The lowest row that each row reaches over links."""
    n = sum(linked.shape) if split else len(linked)
    label = np.arange(n)
    while True:
        before = label.copy()
        if split:
            label[:split] = np.minimum(label[:split], np.where(linked, label[None, split:], n).min(axis=1, initial=n))
            label[split:] = np.minimum(label[split:], np.where(linked.T, label[None, :split], n).min(axis=1, initial=n))
        else:
            label = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        label = label[label]
        if (label == before).all():
            return label


def _link(part):
    """Links that join what is similar within the families, or between the two blocks of a family, of one group."""
    part = part.combine_chunks().sort_by([("family", "ascending"), ("side", "ascending")])
    names, side = part["node"].combine_chunks(), part["side"].to_numpy()
    family = part["family"].combine_chunks().dictionary_encode().indices.to_numpy()
    members = part["members"].combine_chunks()
    edge = np.append(np.flatnonzero(np.diff(family, prepend=-1)), len(family))
    a, b = [], []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        sets = [np.frombuffer(members[i].as_buffer(), np.uint64) for i in range(lo, hi)]
        split = int((side[lo:hi] == 0).sum()) % (hi - lo)
        rows = np.repeat(np.arange(hi - lo), [len(x) for x in sets])
        label = joined(similar_pairs(rows, np.concatenate(sets), hi - lo, split), split)
        tied = np.flatnonzero(label != np.arange(hi - lo))
        a.append(lo + tied)
        b.append(lo + label[tied])
    a, b = (pa.array(np.concatenate(x)) for x in (a, b))
    return pa.table({"a": names.take(a), "b": names.take(b)})


def _sets(part) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in part["members"].combine_chunks()]


def _frequent(part):
    """The frequent shingles of one block of a family, ascending, and how often each is there."""
    sets = _sets(part)
    keys, often = np.unique(np.concatenate(sets), return_counts=True)
    kept = (often > 1) & (often * FREQUENT >= len(sets))
    row = {"family": [part["family"][0].as_py()], "keys": [keys[kept].tobytes()], "often": [often[kept].tobytes()]}
    return pa.table(row, pa.schema([("family", pa.binary()), ("keys", pa.binary()), ("often", pa.binary())]))


def prefix(keys: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The keys that a similar set must share one of: the first in the order of (how often in the family, key)."""
    rank = np.zeros(len(keys), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        rank = np.where(frequent[at] == keys, often[at], 0)
    need = -(-SIMILAR[0] * len(keys) // SIMILAR[1])
    return keys[np.lexsort((keys, rank))][: len(keys) - need + 1]


def _prefixes(part, table):
    """(key, node): the prefixes of one block of a family, keys being of this family alone."""
    if not len(part):
        return pa.table({"key": pa.array([], pa.int64()), "node": pa.array([], pa.binary())})
    frequent, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(table):
        frequent, often = np.frombuffer(table["keys"][0].as_buffer(), np.uint64), np.frombuffer(table["often"][0].as_buffer(), np.int64)
    own = np.frombuffer(part["family"][0].as_py()[:8], np.uint64)
    first = [prefix(x, frequent, often) for x in _sets(part)]
    nodes = part["node"].combine_chunks().take(pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first])))
    return pa.table({"key": pa.array(mix(np.concatenate(first) + own).view(np.int64)), "node": nodes})


def _sized(families: DataFrame) -> DataFrame:
    """(node, family, n): with the members of each family."""
    return families.join(families.groupBy("family").agg(F.count("*").alias("n")), "family").select("node", "family", "n")


def _split(members: DataFrame, large: DataFrame) -> DataFrame:
    """(node, family) of ``large`` (node, family, n) with families cut to what shares prefixes; nodes that share none are left out."""
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = large.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    frequent = members.join(dealt.where("block = 0"), "node").groupBy("family").applyInArrow(_frequent, "family binary, keys binary, often binary")
    places = large.select("family", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("place")).distinct()
    tables = common.stage(frequent, "frequent").join(places, "family").select(F.col("family").alias("of"), "place", "keys", "often").groupBy("of", "place")
    rows = members.join(dealt, "node").groupBy("family", "block")
    keys = common.stage(rows.cogroup(tables).applyInArrow(_prefixes, "key bigint, node binary"), "prefixes")
    star = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    edges = keys.join(star, "key").select(F.col("node").alias("a"), "b").where("a != b").distinct()
    return components(edges).select("node", F.col("component").alias("family"))


def split_families(members: DataFrame, families: DataFrame) -> DataFrame:
    """(node, family): families above ``BLOCK`` members are split by prefixes as long as that halves them.

    A part goes through another round only if it has at most half of its family's members, so rounds grow with the
    logarithm of the largest family; whether a round is needed is all that reaches the driver.
    """
    sized = common.stage(_sized(families), "families")
    done, large = sized.where(F.col("n") <= BLOCK).select("node", "family"), sized.where(F.col("n") > BLOCK)
    while not large.isEmpty():
        was = large.select("node", F.col("n").alias("was"))
        now = common.stage(_sized(_split(members, large)).join(was, "node"), "families")
        again = (F.col("n") > BLOCK) & (F.col("n") * 2 <= F.col("was"))
        done, large = done.unionByName(now.where(~again).select("node", "family")), now.where(again).select("node", "family", "n")
    return done


def _links(members: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b): enough links to join all similar members of each family (node, family).

    A family of more than ``BLOCK`` members is dealt into blocks, and each pair of blocks is one group; smaller
    families share groups of about ``BLOCK`` members.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = members.join(families, "node").join(sizes, "family")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    small = F.pmod(F.xxhash64("family"), F.lit(-(-total // BLOCK) + 1))
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    one = rows.where("blocks = 1").select(F.lit(None).cast("binary").alias("of"), small.alias("i"), F.lit(0).cast("long").alias("j"), "family", "node", "members", F.lit(0).cast("long").alias("side"))
    many = rows.where("blocks > 1").withColumn("mine", mine).withColumn("other", pairs)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    many = many.select(F.col("family").alias("of"), low.alias("i"), high.alias("j"), "family", "node", "members", (F.col("mine") > low).cast("long").alias("side"))
    return one.unionByName(many).groupBy("of", "i", "j").applyInArrow(_link, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for each row: the lowest id of its group of near-duplicates, links being followed."""
    spark = common.ready(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("node"), F.coalesce(text_col, F.lit("")).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    signed = common.stage(named.mapInArrow(_bands, f"doc_id {id_type}, node binary, bands array<bigint>"), "signatures")
    unique = signed.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    each = unique.select("node", F.explode("bands").alias("band"))
    full = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = common.stage(each.join(full, "band").select("band", "node"), "buckets")
    wanted = common.stage(buckets.select("node").distinct(), "nodes")
    texts = common.semi_join(named.select("node", "text"), wanted, "node", 16).dropDuplicates(["node"])
    members = common.stage(texts.mapInArrow(_members, "node binary, members binary"), "members")
    star = buckets.groupBy("band").agg(F.min("node").alias("b"))
    families = components(buckets.join(star, "band").select(F.col("node").alias("a"), "b"))
    families = split_families(members, families.select("node", F.col("component").alias("family")))
    label = components(_links(members, families))
    placed = signed.join(label, "node", "left").select("doc_id", F.size("bands").alias("n"), F.coalesce("component", "node").alias("component"))
    lowest = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    grouped = placed.where("n > 0").join(lowest, "component").select("doc_id", "class_id")
    return grouped.unionByName(placed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the lowest id, null ids last; of equal rows one stays."""
    keyed = docs.withColumn(common.ROW_KEY, common.row_key(id_col, text_col))
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(common.ROW_KEY).alias("key"))
    found = near_duplicates(keyed.select(name.alias("name"), F.col(text_col).alias("text")), "name", "text")
    gone = common.stage(found.where("doc_id != class_id").select(F.col("doc_id.key").alias(common.ROW_KEY)).distinct(), "near-copies")
    left = common.anti_join(keyed, gone, common.ROW_KEY)
    if not left.groupBy(common.ROW_KEY).count().where("count > 1").isEmpty():
        left = left.dropDuplicates([common.ROW_KEY])
    return left.drop(common.ROW_KEY)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (SELECT md5(text) AS k, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (
    SELECT k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g, count(*) AS n
    FROM u, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) GROUP BY ALL
), size AS (SELECT k, sum(n) AS n FROM s GROUP BY k),
pair AS (SELECT x.k AS a, y.k AS b, sum(least(x.n, y.n)) AS c FROM s x JOIN s y ON x.g = y.g AND x.k < y.k GROUP BY ALL),
link AS (
    SELECT a, b FROM pair JOIN size p ON p.k = a JOIN size q ON q.k = b WHERE 5 * c >= 4 * (p.n + q.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT k AS a, k AS b FROM u UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
first AS (SELECT md5(text) AS k, min(doc_id) AS m FROM d GROUP BY text),
class AS (SELECT a AS k, min(m) AS m FROM reach JOIN first ON first.k = b GROUP BY a)
SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE m END AS class_id, CASE WHEN len(w) = 0 THEN true ELSE doc_id = m END AS kept
FROM d LEFT JOIN class ON k = md5(text)
"""
