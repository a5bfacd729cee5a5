"""What the operators share: stored intermediate tables and vectorised word hashing inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 500_000
"""Text handled at once inside a task; a longer text is a chunk of its own."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="touchline-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Words inside a task -------------------------------------------------------------------------------------------------

_TABLES: dict[int, np.ndarray] = {}
_NEAR = 64
"""Bytes of a word whose values come from a table."""


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    """A random number for each place in a word, up to ``_NEAR``, and byte there."""
    if seed not in _TABLES:
        _TABLES[seed] = _byte_values(np.arange(_NEAR * 256, dtype=np.uint64), seed)
    return _TABLES[seed]


def _byte_values(place_and_byte: np.ndarray, seed: int) -> np.ndarray:
    return mixed(mixed(place_and_byte + np.uint64(1)) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes of ranges that follow one another without overlap and aren't empty.

    A sum of numbers drawn for each byte at its place (tabulation hashing), so that no structure of the bytes makes ranges collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64)
    at = place + np.repeat(starts - first, size)
    place -= np.repeat(first, size)
    key = (place << 8) | data[at]
    near = place < _NEAR
    if near.all():
        values = _byte_table(seed)[key]
    else:
        values = np.empty(len(key), np.uint64)
        values[near] = _byte_table(seed)[key[near]]
        values[~near] = _byte_values(key[~near].astype(np.uint64), seed)
    return mixed(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) + right * np.uint64(0x9E3779B97F4A7C15))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many ranges, which aren't empty and may overlap.

    Ranges of 1, 2, 4... values are hashed from two halves; any other one from two of these that overlap and its length.
    """
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    level, reach = values, 1
    left = np.ones(len(size), bool)
    while len(size):
        mine = np.flatnonzero(left & (size < 2 * reach))
        if len(mine):
            out[mine] = mixed(_joined(level[starts[mine]], level[ends[mine] - reach]) + size[mine].astype(np.uint64))
            left[mine] = False
        if not left.any():
            break
        level, reach = _joined(level[:-reach], level[reach:]), 2 * reach
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts.

    ``first[i]:first[i + 1]`` are the words of text i; ``starts`` and ``ends`` are byte offsets in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, bare: bool = False):
        """``fold`` lower-cases A-Z; ``bare`` takes runs of ASCII letters, digits and non-ASCII bytes as words instead."""
        self.data, self.offsets = data, offsets
        n = len(data)
        if bare:
            word = (data >= 128) | ((data >= 48) & (data <= 57)) | (((data | 32) >= 97) & ((data | 32) <= 122))
        else:
            word = (data != 32) & ((data < 9) | (data > 13))
        if fold:
            self.data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        after = np.zeros(n + 1, bool)
        after[:n] = word
        before = np.zeros(n + 1, bool)
        before[1:] = word
        self.starts = np.flatnonzero((after & (~before | begin))[:n])
        self.ends = np.flatnonzero((before & (~after | begin)))
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, seed)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows with about ``size`` bytes of text; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def crc_fold(column: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
