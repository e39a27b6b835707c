"""Shared helpers: text chunks as numpy arrays, word hashes, and lineage cuts.

Texts travel from Spark to Python as Arrow batches.  `text_chunks` shows a
batch as byte arrays of bounded size without copying it, and `WordTable`
finds and hashes every word of a chunk with whole-array operations.
"""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 2048
BATCH_ROWS_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_MASK = (1 << 64) - 1
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own only where none is named and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or "/tmp/quillspark-checkpoints"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Each `cut` writes Parquet and reads it back, so a lost executor only costs
    the tasks after the last cut.  `drop` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/quill-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        # Whole texts go to Python: a batch is held by the JVM and by the worker, so its rows are kept few.
        before = self.spark.conf.get(BATCH_ROWS_CONF)
        self.spark.conf.set(BATCH_ROWS_CONF, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_ROWS_CONF, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._quill_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_quill_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes groups and buckets to the data."""
    return docs.select(F.sum(F.octet_length(F.col(col).cast("string"))).alias("b")).first()["b"] or 0


def groups_for(total_bytes: int, each: int) -> int:
    return max(1, -(-int(total_bytes) // each))


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system: an idle worker stands beside its executor's heap, and keeps what it once took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def rng_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, size=n, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E6C63D0876A9A47)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC13FA9A902A6328F)
    h ^= h >> np.uint64(32)
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair (a, b); equal pairs get equal names everywhere."""
    h = a * np.uint64(0x8EBC6AF09C88C6E3)
    h ^= h >> np.uint64(31)
    h += b * np.uint64(0x589965CC75374CC3)
    h ^= h >> np.uint64(28)
    h *= np.uint64(0x1D8E4E27C47D124F)
    h ^= h >> np.uint64(30)
    return h


def _next(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x8EBC6AF09C88C6E3)
    h += b
    h ^= h >> np.uint64(32)
    return h


def window_hashes(units: np.ndarray, length: int, also: int = 0):
    """Hash of each run of `length` units, by doubling; windows may span documents.

    With `also`, a power of two below `length`, the hashes of its runs come along.
    """
    n = len(units) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 if also else np.zeros(0, np.uint64)
    have, at, out, level, width, short = length, 0, None, units, 1, None
    while have:
        if width == also:
            short = level
        if have & width:
            piece = level[at : at + n]
            out = piece if out is None else _next(out, piece)
            at += width
            have -= width
        if have:
            level = _next(level[:-width], level[width:])
            width *= 2
    return (mix(out), short) if also else mix(out)


class Chunk:
    """Texts of consecutive rows: ids, bytes of all texts, and where each begins."""

    __slots__ = ("rows", "ids", "null", "data", "offsets")

    def __init__(self, rows, ids, null, data, offsets):
        self.rows, self.ids, self.null, self.data, self.offsets = rows, ids, null, data, offsets

    def __len__(self):
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, col: str = "text", key: str = "doc_id"):
    """Chunks of a batch of at most `limit` bytes and CHUNK_ROWS rows each; a longer text is a chunk of its own."""
    if batch.num_rows == 0:
        return
    text = batch.column(batch.schema.get_field_index(col))
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        kind = np.int64
    else:
        kind = np.int32
    null = text.is_null().to_numpy(zero_copy_only=False)
    bufs = text.buffers()
    offsets = np.frombuffer(bufs[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    ids = batch.column(batch.schema.get_field_index(key))
    i = 0
    while i < len(text):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + CHUNK_ROWS, len(text))
        yield Chunk((i, j), ids.slice(i, j - i), null[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    give_back()


class WordTable:
    """Words as runs of bytes outside `separators`; `lower` folds A-Z."""

    def __init__(self, separators: bytes, lower: bool, seed: int = 7):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.values = rng_table(seed, 256)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.values[~self.is_word] = 0
        self.powers = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            steps = np.full(max(n, 256), 0xD6E8FEB86659FD93, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        return self.powers

    def words(self, chunk: Chunk):
        """(hash, first byte, end byte) of each word, and each document's first word."""
        data, n = chunk.data, len(chunk.data)
        none = np.zeros(0, np.int64)
        if not n:
            return np.zeros(0, np.uint64), none, none, np.zeros(len(chunk) + 1, np.int64)
        inside = self.is_word[data]
        begin = np.empty(n, bool)
        begin[0] = inside[0]
        np.greater(inside[1:], inside[:-1], out=begin[1:])
        edge = chunk.offsets[:-1][chunk.offsets[:-1] < n]
        begin[edge] = inside[edge]
        ends = np.empty(n + 1, bool)
        ends[0], ends[n] = False, inside[-1]
        np.greater(inside[:-1], inside[1:], out=ends[1:n])
        inner = edge[edge > 0]
        ends[inner] = inside[inner - 1]
        starts, stops = np.flatnonzero(begin), np.flatnonzero(ends)
        firsts = np.searchsorted(starts, chunk.offsets).astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, stops, firsts
        at = np.zeros(n, np.int32)
        at[starts] = starts
        np.maximum.accumulate(at, out=at)
        np.subtract(np.arange(n, dtype=np.int32), at, out=at)
        at[~inside] = 0
        v = self.values[data]
        v *= self._powers(int(at.max()) + 1)[at]
        h = np.add.reduceat(v, starts)
        h += (stops - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mix(h), starts, stops, firsts


def in_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of `values` stand in the sorted `table`."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
