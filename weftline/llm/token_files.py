"""Token ids of a corpus in Huffman-coded blocks, written in document order and read back.

Documents are dealt by ranges of their id and sorted; each range is encoded once and staged with its running
offset and its counts of ids. The sums of these counts over all documents (one row an id of the vocabulary) give one canonical code
of at most ``LONGEST`` bits, and every staged range is coded in blocks of whole documents. The file format is a folder
of Parquet tables:

* ``codebook``: one row an id: (id, bits). Canonical codes follow from the lengths: ordered by (bits, id).
* ``ranges``: (part, base): the ids before each range.
* ``blocks``: (part, off, doc_ids, n_tokens, n, checkpoints, payload): ``off`` is the block's first id within
  the range, ``payload`` the bits, most significant first, and ``checkpoints`` the bit offset of every
  ``STRIDE``-th id. A block can be decoded alone, and from any checkpoint.

Decoding looks as many bits as the longest code has up in one table and runs all stretches between checkpoints in step.

Order: null ids first, then by id and, among equal ids, by text. Null and empty texts are encoded as empty and
still get the end id.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import common
from weftline.llm.ragged import NOT_SPACE, SINGLE, Words, list_parts, give_back, lists, packed, ragged_index, text_slices, tidy, unpacked
from weftline.session import fresh_path

END = 1
LONGEST = 20
#: Bits that hold the length of a code.
WIDTH = 5
STRIDE = 128
BLOCK_TOKENS = 1 << 16
#: A word of one id that stands between words encoded together, and how many those are.
MARK, TOGETHER = "\0", 500
#: Words whose ids a task remembers at a time.
REMEMBERED = 1_000_000
#: Pieces that are encoded alone: digits, runs of ASCII letters, runs of ASCII marks. The apostrophe (contractions), the bar (special
#: strings) and all else stay with what stands next to them.
PIECES = np.zeros(256, np.uint8)
PIECES[0x21:0x7F], PIECES[0x30:0x3A] = 3, SINGLE
PIECES[0x41:0x5B] = PIECES[0x61:0x7B] = 2
PIECES[[0x27, 0x7C]] = 0
#: Bytes of text encoded at a time; the tokenizer's own memory leaves less room than other operators have.
ENCODED_BYTES = 1_000_000


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and process, so tasks that follow each other share what it remembers."""
    return WordEncoder(path)


class WordEncoder:
    """A tokenizer that drops white space, never joins words over it and parts ASCII letters, digits and marks, applied to each different piece once."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        self.known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, first ids, ids

    def __reduce__(self):
        return word_encoder, (self.path,)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word: many words a text, told apart by a mark that stands between them."""
        if self.tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a process on each core already
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        plain = [i for i, w in enumerate(words) if MARK not in w] if len(self.mark) == 1 else []
        ids, n = [], np.zeros(len(words), np.int64)
        for i in range(0, len(plain), TOGETHER):
            part = plain[i : i + TOGETHER]
            found = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words[k] for k in part)], add_special_tokens=False)[0].ids, np.int32)
            mark = found == self.mark[0]
            n[part] = np.diff(np.concatenate([[-1], np.flatnonzero(mark), [len(found)]])) - 1
            ids.append(found[~mark])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if len(plain) < len(words):
            rest = sorted(set(range(len(words))) - set(plain))
            own = [np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.int32) for k in rest]
            n[rest] = [len(x) for x in own]
            owner = np.concatenate([np.repeat(plain, n[plain]), np.repeat(rest, n[rest])]).astype(np.int64)
            flat = np.concatenate([flat, *own])[np.argsort(owner, kind="stable")]
        return flat, n

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remember new words as one more table; sixteen tables become one, and a table that is too long is given up."""
        flat, n = self._encode_words(words)
        self.known.append((hashes, np.append(0, np.cumsum(n)), flat))
        if len(self.known) > 16:
            known = np.concatenate([k for k, _, _ in self.known])
            n = np.concatenate([np.diff(start) for _, start, _ in self.known])
            flat = np.concatenate([ids for _, _, ids in self.known])
            order = np.argsort(known)
            flat = flat[ragged_index((np.cumsum(n) - n)[order], n[order])]
            self.known = [(known[order], np.append(0, np.cumsum(n[order])), flat)] if len(known) <= REMEMBERED else self.known[-1:]

    def _recall(self, hashes: np.ndarray):
        """(places among ``hashes``, their rows, first ids, ids) of what each table knows."""
        for known, start, ids in self.known:
            at = np.searchsorted(known, hashes)
            ok = at < len(known)
            ok[ok] = known[at[ok]] == hashes[ok]
            yield np.flatnonzero(ok), at[ok], start, ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each text."""
        words = Words(data, offsets, NOT_SPACE, PIECES)
        once, first, where = np.unique(words.hash, return_index=True, return_inverse=True)
        n, parts = np.full(len(once), -1, np.int64), []

        def take(found) -> None:
            for place, row, start, ids in found:
                n[place] = start[row + 1] - start[row]
                parts.append((place, ids[ragged_index(start[row], n[place])]))

        take(self._recall(once))
        new = np.flatnonzero(n < 0)
        if len(new):
            raw = data.tobytes()
            places = first[new]
            self._learn(once[new], [raw[a:b].decode() for a, b in zip(words.start[places].tolist(), words.end[places].tolist(), strict=True)])
            take((new[place], row, start, ids) for place, row, start, ids in list(self._recall(once[new])))
        start = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.int32)
        for place, ids in parts:
            flat[ragged_index(start[place], n[place])] = ids
        ids = flat[ragged_index(start[where], n[where])]
        return ids, np.diff(np.append(0, np.cumsum(n[where]))[words.first])


def with_end(ids: np.ndarray, n: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids and then ``end``."""
    out = np.full(len(ids) + len(n), end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def encode_ranges(docs: DataFrame, encoder: WordEncoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged ids: (part, off, doc_id, low, high, used, counts), ranges of documents in order, ``off`` counting ids within a range.

    ``low`` and ``high`` are the lower and upper 16 bits of each id, little-endian; the upper ones are mostly zero and compress away. The last row of a range is no document: ``off`` is the range's number of ids, ``used`` and ``counts`` are its
    different ids and how often each occurs.
    """
    spark = common.ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["part", "off", "doc_id", "low", "high", "used", "counts"]

    @tidy
    def encode(batches):
        part, off, doc_type = TaskContext.get().partitionId(), 0, None
        total = np.zeros(0, np.int64)
        for batch in batches:
            doc_type = batch.column(0).type
            for lo, hi, data, offsets in text_slices(batch.column(1), ENCODED_BYTES):
                ids, n = with_end(*encoder.encode(data, offsets))
                starts = off + np.cumsum(n) - n
                off += int(n.sum())
                own = np.bincount(ids)
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
                columns = [pa.array([part] * (hi - lo), pa.int32()), pa.array(starts), batch.column(0).slice(lo, hi - lo)]
                columns += [packed(ids.astype("<u2"), n), packed((ids >> 16).astype("<u2"), n)]
                nothing = [pa.nulls(hi - lo, pa.list_(pa.int32())), pa.nulls(hi - lo, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *nothing], names)
        used = np.flatnonzero(total)
        if len(used):
            columns = [pa.array([part], pa.int32()), pa.array([off], pa.int64()), pa.nulls(1, doc_type), *[pa.nulls(1, pa.binary())] * 2]
            columns += [lists(used.astype(np.int32), np.array([len(used)]), pa.int32()), lists(total[used], np.array([len(used)]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, off bigint, doc_id {kind}, low binary, high binary, used array<int>, counts array<bigint>"
    return common.stage(rows.mapInArrow(encode, schema), "token-ids")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, from what each range has counted, added up in each task first; the documents' ids are not read again."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            used, n = list_parts(batch.column(0))[0], list_parts(batch.column(1))[0]
            total = np.append(total, np.zeros(max(0, int(used.max(initial=-1)) + 1 - len(total)), np.int64))
            np.add.at(total, used, n)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    counted = encoded.where("used IS NOT NULL").select("used", "counts")
    return counted.mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with no code above ``longest`` bits, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = [(int(counts[i]), k) for k, i in enumerate(order)]  # (weight, leaf), leaves numbered by rising weight
    level: list[tuple[int, int]] = leaves
    taken = []
    for _ in range(longest - 1):
        packs = [(level[i][0] + level[i + 1][0], -1) for i in range(0, len(level) - 1, 2)]
        taken.append(level)
        level = list(heapq.merge(leaves, packs, key=lambda x: x[0]))
    taken.append(level)
    bits = np.zeros(n, np.int64)
    need = 2 * n - 2
    for items in reversed(taken):  # the first ``need`` items of a level: its leaves get a bit, its packs name two below
        used = [leaf for _, leaf in items[:need] if leaf >= 0]
        bits[order[: len(used)]] += 1
        need = 2 * (need - len(used))
    return bits


class Codebook:
    """A canonical code: codes in order of (bits, id), and the table that decodes it."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.deep = int(self.bits.max(initial=1))
        width = np.int64(1) << (self.deep - self.bits)
        self.codes = (np.cumsum(width) - width) >> (self.deep - self.bits)
        self.place = np.full(int(self.ids.max(initial=0)) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        self._width = width

    def table(self) -> np.ndarray:
        """For every next ``deep`` bits the id that they begin with and, in the lowest ``WIDTH`` bits, the length of its code."""
        if not hasattr(self, "_table"):
            rows = np.repeat(np.arange(len(self.ids)), self._width)
            rows = np.append(rows, np.zeros((1 << self.deep) - len(rows), np.int64))
            self._table = (self.ids << WIDTH | self.bits)[rows]
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of a block and the bit offset of every ``STRIDE``-th id."""
        place = self.place[ids]
        bits, code = self.bits[place], self.codes[place].astype(np.uint64)
        end = np.cumsum(bits)
        start = end - bits
        words = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
        word, within = start >> 6, start & 63
        room = 64 - within - bits
        fits = room >= 0
        first = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        head = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[head]] |= np.bitwise_or.reduceat(first, head)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        size = -(-int(end[-1]) // 8)
        return words.astype(">u8").tobytes()[:size], start[::STRIDE].astype(np.uint32)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block; the stretches after the checkpoints are read in step."""
        table = self.table()
        # what runs on behind the last id of the block reads zeros, at most ``STRIDE`` codes of them
        data = np.frombuffer(payload + bytes(STRIDE * LONGEST // 8 + 8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        lanes = len(checkpoints)
        out = np.zeros((STRIDE, lanes), np.int64)
        at = checkpoints.astype(np.int64)
        left = n - STRIDE * (lanes - 1)
        unused = np.uint32(32 - self.deep)
        for step in range(STRIDE if lanes > 1 else left):
            found = table[window[at >> 3] << (at & 7).astype(np.uint32) >> unused]
            out[step] = found
            at += found & ((1 << WIDTH) - 1)
        return (out.T.ravel()[:n] >> WIDTH).astype(np.int32)


def write_tokens(encoded: DataFrame, path: str) -> None:
    """Write staged ids in the file format."""
    spark = common.ready(encoded.sparkSession)
    counts = id_counts(encoded).toArrow()  # at most one row an id of the vocabulary
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    bits = code_lengths(n)
    spark.createDataFrame(pa.table({"id": pa.array(ids.astype(np.int32)), "bits": pa.array(bits.astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codebook")
    parts = encoded.where("used IS NOT NULL").select("part", F.col("off").alias("n"))  # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/ranges")
    book = spark.sparkContext.broadcast(Codebook(ids, bits))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"part int, off bigint, doc_ids array<{kind}>, n_tokens array<int>, n bigint, checkpoints binary, payload binary"

    @tidy
    def blocks(batches):
        word_encoder.cache_clear()
        give_back()
        for batch in batches:
            part, off = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, n = unpacked(batch.column(3), "<u2")
            flat = flat | unpacked(batch.column(4), "<u2")[0].astype(np.int32) << 16
            edge = np.append(0, np.cumsum(n))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + BLOCK_TOKENS, "right")) - 1)
                run = np.flatnonzero((np.diff(part[lo:hi]) != 0) | (np.diff(off[lo:hi]) != n[lo : hi - 1]))
                hi = lo + 1 + int(run[0]) if len(run) else hi  # a file of another range, or not its next rows
                payload, checkpoints = book.value.encode(flat[edge[lo] : edge[hi]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[lo]], pa.int32()),
                        pa.array([off[lo]], pa.int64()),
                        pa.array([batch.column(2).slice(lo, hi - lo).to_pylist()], pa.list_(batch.column(2).type)),
                        pa.array([n[lo:hi].tolist()], pa.list_(pa.int32())),
                        pa.array([int(edge[hi] - edge[lo])], pa.int64()),
                        pa.array([checkpoints.tobytes()], pa.binary()),
                        pa.array([payload], pa.binary()),
                    ],
                    ["part", "off", "doc_ids", "n_tokens", "n", "checkpoints", "payload"],
                )
                lo = hi

    documents = encoded.where("used IS NULL").select("part", "off", "doc_id", "low", "high")
    with common.small_batches(spark):
        documents.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: tuple[str, str, Callable] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``start`` counts the ids before it.

    ``digest`` = (name, type, function of flat ids and lengths) gives a column that is made where blocks are decoded, instead of ``ids``.
    """
    name, of, make = digest or ("ids", "array<int>", lambda ids, n: lists(ids, n, pa.int32()))
    common.ready(spark)
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    sent = spark.sparkContext.broadcast(Codebook(book["id"].to_numpy(), book["bits"].to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    @tidy
    def decode(batches):
        word_encoder.cache_clear()  # a process that has encoded before needs that memory no more
        give_back()
        for batch in batches:
            for row in range(batch.num_rows):
                part, off, doc_ids, n_tokens, total, checkpoints, payload = (batch.column(i)[row] for i in range(7))
                ids = sent.value.decode(payload.as_py(), np.frombuffer(checkpoints.as_py(), np.uint32), total.as_py())
                n = n_tokens.values.to_numpy().astype(np.int64)
                starts = off.as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(n), pa.int32()), doc_ids.values, pa.array(starts), pa.array(n), make(ids, n)],
                    ["part", "doc_id", "off", "n_tokens", name],
                )

    docs = blocks.mapInArrow(decode, f"part int, doc_id {kind}, off bigint, n_tokens bigint, {name} {of}")
    bases = spark.read.parquet(f"{path}/ranges")  # one row a range, so as many as the writer's partitions
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("off")).alias("start"), "n_tokens", name)


def _checksums(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    edge = np.append(0, np.cumsum(n)).tolist()
    raw = ids.astype("<u4").tobytes()
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.int64())


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, read back, and return each document's place and checksum."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_tokens(encode_ranges(docs, word_encoder(tokenizer)), path)
    return read_tokens(docs.sparkSession, path, ("ids_crc32", "bigint", _checksums))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
