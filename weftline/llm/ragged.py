"""Numpy work on ragged text: the words of many texts as flat arrays of places and 64-bit hashes.

Texts come as Arrow string arrays and are taken in slices of bounded bytes (one text is never cut), so a
task's memory follows the slice and its longest text, not the batch. Words are found on UTF-8 bytes: both word
rules in use treat every byte from 0x80 as part of a word, which is what they say of the code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

#: `[^\x20\x09-\x0D]+` on bytes
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on bytes that are already lower case
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[0x30:0x3A] = LETTER_OR_DIGIT[0x61:0x7B] = LETTER_OR_DIGIT[0x80:] = True

#: A kind of byte (see `Words`) that is always a word of its own among bytes of a kind.
SINGLE = 1

#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_random = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least ``n`` powers of the hash step (or of its inverse) modulo 2**64, from power 0."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), _STEP_INVERSE if inverse else _STEP)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of the rows in them) of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of some texts: ``first`` (by text, one more at the end), ``start``/``end`` in bytes, ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, kinds: np.ndarray | None = None):
        """``kinds`` (by byte) cuts words further, between bytes of two different kinds above 0 and between any two of ``SINGLE``."""
        inside = allowed[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        if kinds is not None and len(data):
            kind = kinds[data]
            left, right = kind[:-1], kind[1:]
            stay = (left == 0) | (right == 0) | ((left == right) & (left != SINGLE))
            before[1:-1] &= stay
            after[1:-1] &= stay
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_sums(data[inside], self.end - self.start)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))


def span_sums(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the spans that ``data`` consists of; none may be empty."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    base = np.cumsum(lengths) - lengths
    within = np.arange(len(data)) - np.repeat(base, lengths)
    return mix(np.add.reduceat(_BYTE[data] * powers(int(lengths.max()))[within], base) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; texts are not told apart here."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, np.uint64)
    for j, power in enumerate(powers(n)[:n]):
        total += words[j : j + size] * power
    return mix(total)


class SpanHasher:
    """Hashes of any spans of a word sequence, equal exactly where the words are (64 bits)."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words))[: len(words)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        shift = powers(int(lo.max(initial=0)) + 1, inverse=True)
        return mix((self.sums[hi] - self.sums[lo]) * shift[lo] + (hi - lo).astype(np.uint64))


def ragged_index(lo: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., then lo[1], ...: ``lengths`` places from each ``lo``."""
    base = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(base - lo, lengths)


def lists(values: np.ndarray, lengths: np.ndarray, of: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, of))


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of ``lengths`` values each; the JVM moves it as it is, not value by value."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.itemsize, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, of: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a `packed` column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    size = np.dtype(of).itemsize
    return data[offsets[0] : offsets[-1]].view(of), np.diff(offsets) // size


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on between tasks, next to the JVM's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A task's function over batches that gives its memory back at the end."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied
