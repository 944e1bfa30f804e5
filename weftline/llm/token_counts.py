"""Token counts by rank-synchronous merging: byte-pair encoding of ragged arrays of pre-tokens.

A slice of texts becomes one array of code points; classes of letters, numbers, white space and the rest give the
pre-tokens without a scan in Python. Each different pre-token is merged once: all sequences are held in one
flat array, every sequence's lowest-rank pair is found together, all its occurrences merge from the left, and
finished sequences leave the array. A text's count is the sum over its pre-tokens. Special strings stand apart
first and are one token each, as the library does by default. Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.ragged import span_sums, text_slices

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pre-tokens whose counts a task remembers at a time.
REMEMBERED = 1_000_000


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    return table


def pre_tokens(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin. ``text_start`` marks the first code point of each text.

    The rule: an apostrophe with s, t, re, ve, m, ll or d; or a run of letters, of numbers, or of anything else but
    white space, each with one blank before it; or white space, whose last character before other text stands alone.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[text_start] = 255
    head = kind != before  # a run of one class begins
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last white space of a run that other text follows
    last[:-1] = space[:-1] & ~space[1:] & ~text_start[1:]
    begin = head.copy()
    begin[last] = True
    blank = last & (points == 0x20)
    begin[1:][blank[:-1]] = False  # what follows a blank begins with the blank
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        tail = np.zeros((3, n + 2), np.int64)
        limit = np.cumsum(text_start)
        for k in (1, 2):
            same = np.zeros(n, bool)
            same[: n - k] = limit[k:] == limit[: n - k]
            tail[k, : n - k] = np.where(same[: n - k], points[k:], 0)
        one, two = tail[1, quote], tail[2, quote]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        # what the contraction takes from a run of letters leaves the rest as a run of its own
        begin[after[inside & (size == 2)] - 1] = False
        begin[after[inside]] |= ~blank[after[inside] - 1]
    return np.flatnonzero(begin)


class Merges:
    """The merge table of a byte-level tokenizer as a hash table from pairs of ids to (rank, new id)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
        self.special = [x["content"] for x in whole.get("added_tokens", [])]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left, right, new = (np.array(x, np.int64) for x in zip(*[(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], strict=True))
        self.bits = int(len(pairs) * 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.empty = -1  # a free place of the table, known once it is filled
        self.ranks, self.new = np.full(1 << self.bits, 1 << 40, np.int64), np.zeros(1 << self.bits, np.int64)
        key, rank = left << 32 | right, np.arange(len(pairs))
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]], self.new[at[put]] = key[put], rank[put], new[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, new, at = key[rest], rank[rest], new[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.empty = int(np.flatnonzero(self.keys < 0)[0])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Table places of pairs; those of no merge have a rank above all others."""
        key = left << 32 | right
        at = self._slot(key)
        live = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            live = live[(self.keys[at[live]] != key[live]) & (self.keys[at[live]] >= 0)]
        return np.where(self.keys[at] == key, at, self.empty)

    def counts(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that are left of each byte sequence when all merges are done."""
        out = np.asarray(lengths, np.int64).copy()
        symbols, owner = self.byte[data], np.repeat(np.arange(len(lengths)), lengths)
        pair = np.full(len(symbols), self.empty)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair[inner] = self.find(symbols[inner], symbols[inner + 1])
        while len(symbols):
            rank = self.ranks[pair]
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(head, append=len(owner))
            least = np.minimum.reduceat(rank, head)
            going = least < 1 << 40
            if not going.all():  # finished sequences leave
                out[owner[head[~going]]] = size[~going]
                stay = np.repeat(going, size)
                symbols, owner, pair, rank = symbols[stay], owner[stay], pair[stay], rank[stay]
                least, size = least[going], size[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # in a stretch of overlapping occurrences every second one merges, from the left
            start = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            run = np.repeat(start, np.diff(start, append=len(hit)))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.new[pair[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = (np.cumsum(keep) - 1)[hit]
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            stale = np.unique(np.concatenate([place, place[place > 0] - 1]))
            inner = stale[stale + 1 < len(symbols)]
            inner = inner[owner[inner] == owner[inner + 1]]
            pair[stale] = self.empty
            pair[inner] = self.find(symbols[inner], symbols[inner + 1])
        return out


@cache
def token_counter(path: str) -> Counter:
    """One counter for each file and process, so tasks that follow each other share what it remembers."""
    return Counter(path)


class Counter:
    """Counts of a tokenizer file's tokens, with a memory of pre-tokens."""

    def __init__(self, path: str):
        self.path, self.merges = path, None
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __reduce__(self):
        return token_counter, (self.path,)

    def _of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        once, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, once), max(len(self.known) - 1, 0))
        old = self.known[at] == once if len(self.known) else np.zeros(len(once), bool)
        found = np.zeros(len(once), np.int64)
        found[old] = self.count[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            size = lengths[first[new]]
            base = np.cumsum(size) - size
            flat = data[np.arange(int(size.sum())) - np.repeat(base - start[first[new]], size)]
            found[new] = self.merges.counts(flat, size)
            known, count = np.concatenate([self.known, once[new]]), np.concatenate([self.count, found[new]])
            order = np.argsort(known)
            self.known, self.count = (known[order], count[order]) if len(known) < REMEMBERED else (self.known[:0], self.count[:0])
        return found[where]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if self.merges is None:
            self.merges = Merges(self.path)
        extra = np.zeros(len(offsets) - 1, np.int64)
        cuts = []
        raw = data.tobytes()
        for m in re.finditer(b"|".join(re.escape(x.encode()) for x in sorted(self.merges.special, key=len, reverse=True)) or b"(?!)", raw):
            text = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() <= offsets[text + 1]:
                extra[text] += 1
                cuts.append(m.span())
        if cuts:  # what stands between special strings is tokenized as texts of their own
            edges = np.array([0, *[x for cut in cuts for x in cut], len(data)])
            keep = np.ones(len(data), bool)
            for a, b in cuts:
                keep[a:b] = False
            moved = np.append(0, np.cumsum(keep))
            data, owners = data[keep], offsets
            starts = np.unique(moved[np.concatenate([edges, offsets])])
            offsets = moved[offsets]
        else:
            starts, owners = np.unique(offsets), offsets
        if not len(data):
            return extra
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        text_start = np.zeros(len(points), bool)
        begins = np.searchsorted(lead, starts)
        text_start[begins[begins < len(points)]] = True
        start = lead[pre_tokens(points, text_start)]
        lengths = np.diff(start, append=len(data))
        counts = self._of(span_sums(data, lengths), data, start, lengths)
        total = np.append(0, np.cumsum(counts))[np.searchsorted(start, offsets)]
        return np.diff(total) + extra


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row."""
    common.ready(docs.sparkSession)
    counter = token_counter(tokenizer)

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(counter(data, offsets))], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
