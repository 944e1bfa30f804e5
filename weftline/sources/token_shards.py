"""Binary token shards as a Spark data source, for reading and writing.

A shard is a headerless file of little-endian 16-bit ids, ``shard_%04d.bin``; ``meta.txt`` beside
the shards is their manifest. Each read task gets one byte range; each write task writes whole shards.

A write makes a folder of its own, a version, and becomes visible by one last step: the ``meta.txt`` of the path is
replaced by one that names the version. Until then readers see the version before, whatever breaks; it stays until the
next write, for readers that have already planned. A path without versions holds its shards itself.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from weftline.functions.permutation import permuted
from weftline.session import ship_package
from weftline.sources.manifest import MANIFEST, manifest_text

FORMAT = "token_shards"
# The file names and the number format of published shards.
SHARD_NAME = "shard_{:04d}.bin"
SHARD_PATTERN = re.compile(r"shard_(\d+)\.bin$")
ID_TYPE = np.dtype("<u2")
TOKENS_PER_TASK = 16_000_000
ROWS_PER_BATCH = 500_000
VERSION = "version-{}"
#: Files moved at the same time by a commit.
MOVES = 32
_PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def version_folder(path: str) -> str:
    """The folder that holds the shards of ``path`` now: the version its manifest names, or ``path`` itself."""
    files, root = open_folder(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return path
    with files.open_input_stream(f"{root}/{MANIFEST}") as source:
        facts = dict(line.split("=", 1) for line in source.read().decode().splitlines() if "=" in line)
    return f"{path.rstrip('/')}/{facts['folder']}" if "folder" in facts else path


def list_shards(path: str) -> list[tuple[int, str, int]]:
    """``(shard number, file, tokens)`` in number order, which holds beyond 9,999 shards too."""
    files, root = open_folder(version_folder(path))
    found = []
    for info in files.get_file_info(pafs.FileSelector(root)):
        match = SHARD_PATTERN.search(info.base_name)
        if match and info.is_file:
            found.append((int(match.group(1)), info.path, info.size // ID_TYPE.itemsize))
    return sorted(found)


@dataclass
class TokenRange(InputPartition):
    """Tokens ``[first, first + count)`` of the stream, as pieces of shard files."""

    first: int
    count: int
    pieces: list[tuple[str, int, int]]


def _pieces(shards: list[tuple[int, int, str]], first: int, count: int) -> list[tuple[str, int, int]]:
    """The file parts that hold a range, from ``(start, tokens, file)`` rows in stream order."""
    parts = []
    for start, tokens, file in shards:
        low, high = max(first, start), min(first + count, start + tokens)
        if low < high:
            parts.append((file, low - start, high - low))
    return parts


class ShardReader(DataSourceReader):
    """Rows ``(pos, token)``, or whole blocks when ``seq_len`` is given.

    Comparisons of ``pos`` with a number become the range that is read; the rest is left to Spark.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seq_len = int(options.get("seq_len", 0))
        self.first = int(options.get("start", 0))
        self.length = options.get("length")
        self.max_tokens = int(options.get("max_tokens", 0))
        self.per_task = int(options.get("tokens_per_task", TOKENS_PER_TASK))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = not self.seq_len and getattr(f, "attribute", None) == ("pos",)
            if known and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif not (known and isinstance(f, IsNotNull)):
                yield f

    def placed(self, path: str) -> tuple[list[tuple[int, int, str]], int]:
        """``(start, tokens, file)`` of the shards, and the tokens to be served."""
        placed, total = [], 0
        for _, file, tokens in list_shards(path):
            placed.append((total, tokens, file))
            total += tokens
        if not placed:
            raise FileNotFoundError(f"no shards in {path}")
        return placed, min(total, self.max_tokens) if self.max_tokens else total

    def partitions(self) -> list[InputPartition]:
        placed, total = self.placed(self.path)
        first, last = max(self.first, self.low), total
        if self.length is not None:
            last = min(total, self.first + int(self.length))
        if self.high is not None:
            last = min(last, self.high)
        step, overlap = self.per_task, 0
        if self.seq_len:
            # Cut on block borders; a task also reads the one token its last block shares.
            last = max(last - 1, 0) // self.seq_len * self.seq_len
            step, overlap = max(1, step // self.seq_len) * self.seq_len, 1
        ranges, cursor = [], 0
        for low in range(first, last, step):
            high = min(low + step, last) + overlap
            while placed[cursor][0] + placed[cursor][1] <= low:
                cursor += 1
            ahead = cursor
            while ahead < len(placed) and placed[ahead][0] < high:
                ahead += 1
            ranges.append(TokenRange(low, high - low, _pieces(placed[cursor:ahead], low, high - low)))
        return ranges or [TokenRange(first, 0, [])]

    def read(self, partition: TokenRange) -> Iterator[pa.RecordBatch]:
        chunk = ROWS_PER_BATCH // self.seq_len * self.seq_len if self.seq_len else ROWS_PER_BATCH
        chunk = max(chunk, self.seq_len)
        pos, held = partition.first, np.empty(0, ID_TYPE)
        for file, offset, count in partition.pieces:
            files, path = open_folder(file)
            with files.open_input_file(path) as source:
                while count > 0:
                    size = min(count, chunk)
                    data = source.read_at(size * ID_TYPE.itemsize, offset * ID_TYPE.itemsize)
                    read = np.frombuffer(data, ID_TYPE)
                    offset, count = offset + size, count - size
                    if not self.seq_len:
                        yield _token_batch(pos, read)
                        pos += size
                        continue
                    held = np.concatenate([held, read])
                    full = (len(held) - 1) // self.seq_len
                    if full > 0:
                        yield _block_batch(pos // self.seq_len, held, full, self.seq_len)
                        held = held[full * self.seq_len :]
                        pos += full * self.seq_len


@dataclass
class BatchRange(InputPartition):
    """Batches ``[first, last)`` of one pass over the blocks."""

    epoch: int
    first: int
    last: int
    folder: str


class BatchReader(ShardReader):
    """Training batches in their order: each task works its places' blocks out and reads just those from the files."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.micro_batch, self.epochs, self.seed = (int(options[k]) for k in ("micro_batch", "epochs", "seed"))

    def blocks_in(self, total: int) -> int:
        return max(total - 1, 0) // self.seq_len

    def partitions(self) -> list[InputPartition]:
        folder = version_folder(self.path)  # all tasks read this version
        per_epoch = self.blocks_in(self.placed(folder)[1]) // self.micro_batch
        step = max(1, self.per_task // (self.seq_len * self.micro_batch))
        ranges = [BatchRange(e, b, min(b + step, per_epoch), folder) for e in range(self.epochs) for b in range(0, per_epoch, step)]
        return ranges or [BatchRange(0, 0, 0, folder)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        shards, total = self.placed(partition.folder)
        starts = np.array([start for start, _, _ in shards])
        per_chunk = max(1, ROWS_PER_BATCH // (self.seq_len * self.micro_batch)) * self.micro_batch
        last = partition.last * self.micro_batch
        for low in range(partition.first * self.micro_batch, last, per_chunk):
            places = np.arange(low, min(low + per_chunk, last))
            blocks = permuted(places, self.blocks_in(total), self.seed, partition.epoch)
            tokens = np.empty((len(places), self.seq_len + 1), ID_TYPE)
            opened: dict[str, pafs.NativeFile] = {}
            for k in np.argsort(blocks).tolist():  # in file order, with one file open
                first, filled = int(blocks[k]) * self.seq_len, 0
                touched = slice(*np.searchsorted(starts, [first + 1, first + self.seq_len + 1]) - [1, 0])
                for file, offset, count in _pieces(shards[touched], first, self.seq_len + 1):
                    if file not in opened:
                        for other in opened.values():
                            other.close()
                        files, path = open_folder(file)
                        opened = {file: files.open_input_file(path)}
                    tokens[k, filled : filled + count] = np.frombuffer(opened[file].read_at(count * ID_TYPE.itemsize, offset * ID_TYPE.itemsize), ID_TYPE)
                    filled += count
            for other in opened.values():
                other.close()
            yield _training_batch(partition.epoch, places, blocks, tokens, self.micro_batch)


def _training_batch(epoch: int, places: np.ndarray, blocks: np.ndarray, tokens: np.ndarray, micro_batch: int) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(places) + 1, dtype=np.int32) * (tokens.shape[1] - 1))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).ravel().astype(np.int32))) for part in (tokens[:, :-1], tokens[:, 1:])]
    numbers = [np.full(len(places), epoch), places // micro_batch, places % micro_batch, blocks]
    return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in numbers], *lists], ["epoch", "batch_id", "slot", "block_id", "input_ids", "labels"])


def _token_batch(pos: int, ids: np.ndarray) -> pa.RecordBatch:
    places = np.arange(pos, pos + len(ids), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(places), pa.array(ids.astype(np.int32))], names=["pos", "token"])


def _block_batch(block: int, ids: np.ndarray, full: int, seq_len: int) -> pa.RecordBatch:
    windows = np.lib.stride_tricks.sliding_window_view(ids, seq_len + 1)[:: seq_len][:full]
    flat = pa.array(np.ascontiguousarray(windows).ravel().astype(np.int32))
    ends = pa.array(np.arange(full + 1, dtype=np.int32) * (seq_len + 1))
    blocks = pa.array(np.arange(block, block + full, dtype=np.int64))
    return pa.RecordBatch.from_arrays([blocks, pa.ListArray.from_arrays(ends, flat)], names=["block_id", "tokens"])


@dataclass
class ShardsWritten(WriterCommitMessage):
    folder: str
    shards: list[tuple[int, str, int]]


class ShardWriter(DataSourceArrowWriter):
    """Takes ``(shard_id, lo, piece)`` sorted by both, with all of a shard in one task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite
        self.facts = {k: options[k] for k in ("vocab_size", "eos_id", "dataset", "tokenizer") if k in options}
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = open_folder(self.path)
        folder = f"{root}/_job-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        done, current, sink, written, expected = [], None, None, 0, None
        for batch in iterator:
            for shard, lo, piece in zip(
                batch.column("shard_id").to_pylist(), batch.column("lo").to_pylist(), batch.column("piece")
            ):
                if shard != current:
                    if sink is not None:
                        sink.close()
                        done.append((current, path, written))
                    path = f"{folder}/{SHARD_NAME.format(shard)}"
                    current, sink, written, expected = shard, files.open_output_stream(path), 0, lo
                if lo != expected:
                    raise ValueError(f"shard {shard}: expected position {expected}, got {lo}")
                ids = piece.values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > 65_535):
                    raise ValueError(f"shard {shard}: an id does not fit 16 bits")
                sink.write(ids.astype(ID_TYPE).tobytes())
                written, expected = written + len(ids), lo + len(ids)
        if sink is not None:
            sink.close()
            done.append((current, path, written))
        return ShardsWritten(folder, done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = open_folder(self.path)
        if list_shards(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already holds shards")
        before, version = version_folder(self.path), VERSION.format(self.job)
        files.create_dir(f"{root}/{version}", recursive=True)
        written = [shard for message in messages if message for shard in message.shards]
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda s: files.move(s[1], f"{root}/{version}/{SHARD_NAME.format(s[0])}"), written))
        facts = manifest_text(sum(s[2] for s in written), len(written), **self.facts)
        _write_text(files, f"{root}/{version}/{MANIFEST}", facts)
        self.switch(files, root, version, facts)
        files.delete_dir(f"{root}/_job-{self.job}")
        keep = {version, os.path.basename(before)}
        for info in files.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith(VERSION.format("")) and info.base_name not in keep:
                files.delete_dir(info.path)

    def switch(self, files: pafs.FileSystem, root: str, version: str, facts: str) -> None:
        """The one step that makes a version the current one: a rename on a local disk, a single small put elsewhere."""
        text = f"{facts}folder={version}\n"
        if files.type_name != "local":
            _write_text(files, f"{root}/{MANIFEST}", text)
            return
        _write_text(files, f"{root}/_job-{self.job}/{MANIFEST}", text)
        files.move(f"{root}/_job-{self.job}/{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = open_folder(self.path)
        if files.get_file_info(f"{root}/_job-{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_job-{self.job}")


def _write_text(files: pafs.FileSystem, path: str, text: str) -> None:
    with files.open_output_stream(path) as sink:
        sink.write(text.encode())


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        if "micro_batch" in self.options:
            return "epoch long, batch_id long, slot long, block_id long, input_ids array<int>, labels array<int>"
        if int(self.options.get("seq_len", 0)):
            return "block_id long, tokens array<int>"
        return "pos long, token int"

    def reader(self, schema: StructType) -> ShardReader:
        return (BatchReader if "micro_batch" in self.options else ShardReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TokenShards)
    spark.conf.set(_PUSH_DOWN, "true")


def read_shards(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> DataFrame:
    """``(pos, token)``; ``start`` and ``length``, or a filter on ``pos``, leave other files and byte ranges unread."""
    register(spark)
    reader = spark.read.format(FORMAT).option("start", start)
    return (reader if length is None else reader.option("length", length)).load(path)


def read_shard_blocks(spark: SparkSession, path: str, seq_len: int, max_tokens: int | None = None) -> DataFrame:
    """``(block_id, tokens)``: overlapping blocks straight from the files, without a shuffle."""
    register(spark)
    return spark.read.format(FORMAT).option("seq_len", seq_len).option("max_tokens", max_tokens or 0).load(path)


def read_training_batches(
    spark: SparkSession, path: str, seq_len: int, micro_batch: int, epochs: int, seed: int, max_tokens: int | None = None, tokens_per_task: int = TOKENS_PER_TASK
) -> DataFrame:
    """``(epoch, batch_id, slot, block_id, input_ids, labels)`` in training order within and over the tasks.

    A task computes which blocks its batches hold and reads those bytes: no token is sorted or shuffled.
    """
    register(spark)
    options = {"seq_len": seq_len, "micro_batch": micro_batch, "epochs": epochs, "seed": seed, "max_tokens": max_tokens or 0, "tokens_per_task": tokens_per_task}
    return spark.read.format(FORMAT).options(**options).load(path)


def write_shards(pieces: DataFrame, path: str, overwrite: bool = False, **facts: object) -> None:
    """Write ``(shard_id, lo, piece)`` rows; one task holds one open file and streams into it."""
    register(pieces.sparkSession)
    columns = pieces.select(F.col("shard_id").cast("long"), F.col("lo").cast("long"), F.col("piece").cast("array<int>"))
    ordered = columns.repartition("shard_id").sortWithinPartitions("shard_id", "lo")
    writer = ordered.write.format(FORMAT).mode("overwrite" if overwrite else "append")
    for name, value in facts.items():
        writer = writer.option(name, value)
    writer.save(path)
