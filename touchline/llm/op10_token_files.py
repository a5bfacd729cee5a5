"""Token ids in compressed files: canonical length-limited Huffman codes from global counts.

Each text is encoded once; its ids, followed by an end id, are stored, counted, and dealt by ranges of document ids, so that file after file and inside each the documents ascend.
A file has rows (blocks) of whole documents with about ``BLOCK`` ids: header columns and the documents' bit streams, each from a byte's first bit on. Every ``LANE`` ids the block stores how many bits they took, so a reader finds any lane without decoding those before it; the
lanes of many blocks are decoded side by side by looking up ``limit`` bits in one table. The codebook holds a length for each id; the codes follow from it.
Files are Parquet, so that Spark's commit protocol covers them on any file system.

Edge cases: a null text is empty and has the end id alone; null ids come first, equal ids are ordered by a hash of their ids' bytes; an empty table gives empty files;
one distinct id takes one bit; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, shared_dir, stored, text_chunks
from touchline.llm.tokens import Encoder, definition_at, encoder_of, last_id

LIMIT = 16
BLOCK = 1 << 12
"""Ids of a block; Spark hands thousands of rows at once to a task, so blocks are small."""
TOGETHER = 1 << 18
"""Ids that are packed or decoded at once."""
LANE = 64
PARTITION_BYTES = 64 << 20
BLOCKS = "part int, block int, part_start long, ids long, documents binary, sizes binary, lane_bits binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for a count of 0."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(symbols)
    if n < 2:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    taken = 2 * n - 2
    for flags in reversed(is_leaf):
        mine = int(flags[:taken].sum())
        lengths[order[:mine]] += 1
        taken = 2 * (taken - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each symbol, and the symbols in the order of their codes (by length, then symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        longest = int(lengths.max())
        room = np.int64(1) << (longest - lengths[order])
        codes[order] = (np.cumsum(room) - room) >> (longest - lengths[order])
    return codes, order


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The bit stream of each document, from a byte's first bit on, and the bits of each of its lanes. ``sizes``: ids of each document."""
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    width = (ends[first[1:]] - ends[first[:-1]] + 7) // 8
    byte = np.concatenate([[0], np.cumsum(width)])
    start = ends[:-1] + np.repeat(byte[:-1] * 8 - ends[first[:-1]], sizes)
    value = codes[ids] << (32 - size - (start & 7))
    out = np.zeros(int(byte[-1]) + 4, np.float64)
    for k in range(4):
        out += np.bincount((start >> 3) + k, weights=(value >> (24 - 8 * k)) & 255, minlength=len(out))
    raw = out.astype(np.uint8).tobytes()
    lanes = -(-sizes // LANE)
    within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    bits = np.add.reduceat(size, np.repeat(first[:-1], lanes) + within * LANE).astype("<u2").tobytes() if len(ids) else b""
    until = np.concatenate([[0], np.cumsum(lanes)]) * 2
    return [raw[a:b] for a, b in zip(byte[:-1], byte[1:], strict=True)], [bits[a:b] for a, b in zip(until[:-1], until[1:], strict=True)]


class Table:
    """Decoding table: the next ``width`` bits give an id and its length."""

    def __init__(self, lengths: np.ndarray):
        _, order = canonical_codes(lengths)
        self.width = int(lengths.max(initial=1))
        room = np.int64(1) << (self.width - lengths[order])
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.size = np.ones(1 << self.width, np.int64)
        self.symbol[: room.sum()] = np.repeat(order, room)
        self.size[: room.sum()] = np.repeat(lengths[order], room)

    def unpack(self, bits: bytes, lane_bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of all documents of a block; each step reads one id of every lane."""
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.int64)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        first = np.cumsum(lanes) - lanes
        ends = np.concatenate([[0], np.cumsum(lane_bits)])
        width = (ends[first + lanes] - ends[first] + 7) // 8
        at = ends[:-1] + ((np.cumsum(width) - width) * 8 - ends[first])[owner]
        last = len(window) - 1
        out = np.empty((len(owner), LANE), np.uint32)
        for step in range(LANE):
            code = (window[np.minimum(at >> 3, last)] >> (32 - self.width - (at & 7))) & ((1 << self.width) - 1)
            out[:, step] = self.symbol[code]
            at = at + self.size[code]
        left = sizes[owner] - (np.arange(len(owner)) - first[owner]) * LANE
        return out[np.arange(LANE)[None, :] < left[:, None]]


def _encoded(batch: pa.RecordBatch, encoder: Encoder, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with end ids, ids of each document) for runs of rows."""
    for lo, _, data, offsets in text_chunks(batch):
        ids, counts = encoder.encode_many(data, offsets)
        yield lo, np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def _ids(definition: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = encoder_of(definition), np.dtype(kind).itemsize
        for batch in batches:
            for lo, ids, sizes in _encoded(batch, encoder, end_id):
                raw, ends = ids.astype(kind).tobytes(), width * np.cumsum(sizes)
                each = [raw[a:b] for a, b in zip(ends - width * sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sizes)), pa.array(sizes), pa.array(each, pa.binary())], names=["doc_id", "n", "ids"])
        encoder.forget()  # workers are used again

    return run


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The ids of a column of binary values, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, kind)


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column("ids"), kind), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("ids", pa.int64()), *[(k, pa.binary()) for k in ("documents", "sizes", "lane_bits", "bits")]])


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of values, each of about ``most`` in sum and of at least one value."""
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _blocks(lengths: np.ndarray, kind: str):
    """Blocks of the documents of a partition, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        codes, _ = canonical_codes(lengths)
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for lo, hi in _runs(sizes, TOGETHER):
                some = batch.slice(lo, hi - lo)
                n = sizes[lo:hi]
                bits, lanes = pack(_flat(some.column("ids"), kind).astype(np.int64), n, lengths, codes)
                known = some.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                names = some.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                rows = []
                for a, b in _runs(n, BLOCK):
                    ids = int(n[a:b].sum())
                    header = known[a:b].astype(np.uint8).tobytes() + names[a:b].astype("<i8").tobytes()
                    rows.append({"part": part, "block": block, "part_start": before, "ids": ids, "documents": header, "sizes": n[a:b].astype("<u8").tobytes(), "lane_bits": b"".join(lanes[a:b]), "bits": b"".join(bits[a:b])})
                    block, before = block + 1, before + ids
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` with the tokenizer definition and write codebook and blocks under ``path``."""
    spark = docs.sparkSession
    kind = "<u2" if max(last_id(tokenizer), end_id) < 1 << 16 else "<u4"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids binary"
    encoded = stored(docs.select("doc_id", "text").mapInArrow(_ids(tokenizer, end_id, kind), schema), "token-ids")
    counts = encoded.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has ids
    total = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total)
    book = pd.DataFrame({"id": np.flatnonzero(lengths), "length": lengths[lengths > 0]})
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int((total * lengths).sum()) // (8 * PARTITION_BYTES)))
    order = ["doc_id", F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_blocks(lengths, kind), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(lengths)
        for batch in batches:
            count = batch.column("ids").to_numpy()
            for lo, hi in _runs(count, TOGETHER):
                some = batch.slice(lo, hi - lo)
                column = {k: [x.as_py() for x in some.column(k)] for k in ("documents", "sizes", "lane_bits", "bits")}
                each = [np.frombuffer(x, "<u8").astype(np.int64) for x in column["sizes"]]
                sizes = np.concatenate(each)
                known = np.concatenate([np.frombuffer(x[: len(n)], np.uint8) for x, n in zip(column["documents"], each, strict=True)]) > 0
                names = np.concatenate([np.frombuffer(x[len(n) :], "<i8") for x, n in zip(column["documents"], each, strict=True)])
                raw = table.unpack(b"".join(column["bits"]), np.frombuffer(b"".join(column["lane_bits"]), "<u2").astype(np.int64), sizes).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                ids = [raw[4 * a : 4 * b] for a, b in zip(ends - sizes, ends, strict=True)]
                first = some.column("before").to_numpy() + some.column("part_start").to_numpy() - (np.cumsum(count[lo:hi]) - count[lo:hi])
                start = ends - sizes + np.repeat(first, [len(n) for n in each])
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=~known), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids and their crc32, decoded from the files."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n"))  # a row per written partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(before, "part").mapInArrow(_read(lengths), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), path, definition_at(public_tokenizers.path("byte_bpe_50k.json")))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op10_token_files": op10}
