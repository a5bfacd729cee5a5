r"""Substring dedup by relative Lempel-Ziv parsing against content-defined reference blocks.

Words are ``[^\x20\x09-\x0D]+``. Every window of ``window`` words has an anchor, its 5-word gram of smallest hash, so equal windows
have equal anchors wherever they stand. The consecutive windows of one anchor span a block. The first occurrence of a block (smallest
document id, then smallest position) is the indexed reference block; every later occurrence is a factor of the parse and repeats it
as a whole. Where an anchor has blocks that differ, a repeat can still begin or end inside them: at these factor boundaries
each window is looked up itself. A window that also starts earlier is a repeat, and the words it covers go. The outcome equals that
of comparing all windows; only blocks whose anchor occurs twice are shuffled, and only windows of differing blocks one by one.

Hot groups: all groupings are sums, minima and counts with map-side combination; no group of rows is gathered except by document.

Edge cases: a null text has no words; fewer words than the window are never removed; a null id takes no part and its text is kept; rows
that repeat an id are told apart by their text's hash, which also orders them, and equal rows get equal results; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import Words, documents, mixed, range_hashes, stored, text_chunks

WINDOW = 20
GRAM = 5
_PLACE = np.uint64((1 << 20) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return x if reach == width else np.minimum(x[: -(width - reach)], x[width - reach :])


def anchored_blocks(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, block hash, first window, last window) of all blocks of consecutive texts; windows count from the text's start."""
    h = words.hashes()
    n, grams = len(h), len(h) - GRAM + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 5
    g = np.zeros(grams, np.uint64)
    for j in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + grams]
    g = mixed(g)
    doc = words.doc_of_word()
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    width, step = window - GRAM + 1, int(_PLACE) - window
    anchor = np.empty(grams - width + 1, np.int64)  # of each window
    for lo in range(0, len(anchor), step):
        part = g[lo : lo + step + width - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)  # ties go left
        found = _sliding_min(key, width)
        anchor[lo : lo + len(found)] = (found & _PLACE).astype(np.int64) + lo
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi = starts[first], starts[last]
    base = words.first[doc[lo]]
    block = range_hashes(h, lo, hi + window)
    return doc[lo], g[anchor[first]].view(np.int64), block.view(np.int64), lo - base, hi - base


def _taken(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def blocks(docs: DataFrame, keys: list[str], window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_chunks(batch):
                doc, a, s, first, last = anchored_blocks(Words(data, offsets), window)
                if len(doc):
                    ids = [_taken(batch.column(k), doc + lo) for k in keys]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(a), pa.array(s), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=[*keys, "a", "s", "lo", "hi"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.mapInArrow(run, f"{kinds}, a long, s long, lo int, hi int")


def _ranges(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each struct in a list column's slice, and the struct's fields."""
    part = column.slice(lo, hi - lo)
    count = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    return np.repeat(np.arange(hi - lo), count), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _windows(keys: list[str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("blocks")
            for lo, hi, data, offsets in text_chunks(batch):
                row, f = _ranges(at, lo, hi)
                if not len(row):
                    continue
                words = Words(data, offsets)
                sizes = f["hi"] - f["lo"] + 1
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                owner, place = np.repeat(row, sizes), np.repeat(f["lo"], sizes) + within
                start = words.first[owner] + place
                w = [range_hashes(words.hashes(seed), start, start + window).view(np.int64) for seed in (0, 1)]
                ids = [_taken(batch.column(k), owner + lo) for k in keys]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(w[0]), pa.array(w[1]), pa.array(place.astype(np.int32))], names=[*keys, "w1", "w2", "lo"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("signed")
            for lo, hi, data, offsets in text_chunks(batch):
                words, raw = Words(data, offsets), data.tobytes()
                row, f = _ranges(at, lo, hi)
                total = len(words.starts)
                kept_texts, spans = [], []
                removed = np.zeros(total, bool)
                if len(row):
                    change = np.zeros(total + 1, np.int64)
                    np.add.at(change, words.first[row] + f["lo"], f["sign"])
                    np.add.at(change, words.first[row] + f["hi"] + 1, -f["sign"].astype(np.int64))
                    repeated = np.flatnonzero(np.cumsum(change)[:total] > 0)
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, repeated, 1)
                    np.add.at(cover, repeated + window, -1)
                    removed = np.cumsum(cover)[:total] > 0
                count = np.diff(words.first)
                gone = np.zeros(hi - lo, np.int64)
                np.add.at(gone, words.doc_of_word()[removed], 1)
                for i in range(hi - lo):
                    parts = raw[offsets[i] : offsets[i + 1]].split()
                    mine: list[dict] = []
                    if gone[i]:
                        flags = removed[words.first[i] : words.first[i + 1]]
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                        mine = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        parts = [parts[j] for j in np.flatnonzero(~flags)]
                    kept_texts.append(b" ".join(parts).decode())
                    spans.append(mine)
                part = batch.slice(lo, hi - lo)
                spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(gone), pa.array(spans, spans_type), pa.array(kept_texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "repeats", "kept_text"],
                )

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (word spans that go, end exclusive), kept_text (words left, joined by a space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    keys = ["doc_id"]
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs, keys = docs.withColumn("part", F.xxhash64("text")), ["doc_id", "part"]
    told_apart = docs.where("doc_id IS NOT NULL")
    if len(keys) > 1:
        told_apart = told_apart.dropDuplicates(keys)
    all_blocks = blocks(told_apart, keys, window)
    # stored, so that both sides of the join are plain shuffles, whose hot partitions can be split
    twice = stored(all_blocks.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    found = stored(all_blocks.join(twice, "a", "left_semi"), "blocks")
    reference = stored(found.groupBy("a", "s").agg(F.min(F.struct(*keys, "lo", "hi")).alias("f")).select("a", "s", "f.*"), "references")
    differ = reference.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    settled = reference.join(differ, "a", "left_anti")
    checked = reference.join(differ, "a", "left_semi")
    at_edges = checked.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("blocks"))
    kinds = ", ".join(f"{k} {kind if k == 'doc_id' else 'long'}" for k in keys)
    windows = docs.join(at_edges, keys, "left").select(*keys, "text", "blocks").mapInArrow(_windows(keys, window), f"{kinds}, w1 long, w2 long, lo int")
    opening = windows.groupBy("w1", "w2").agg(F.min(F.struct(*keys, "lo")).alias("f")).select("f.*")
    # +1 for the windows of every block, -1 where they come first
    signed = (
        found.select(*keys, "lo", "hi", F.lit(1).alias("sign"))
        .unionByName(settled.select(*keys, "lo", "hi", F.lit(-1).alias("sign")))
        .unionByName(opening.select(*keys, "lo", F.col("lo").alias("hi"), F.lit(-1).alias("sign")))
    )
    per_text = signed.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "sign")).alias("signed"))
    joined = docs.join(per_text, keys, "left").select("doc_id", "text", "signed")
    return joined.mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, repeats array<struct<start:int,end:int>>, kept_text string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1}
SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i AS start, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
     later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, start + k AS i FROM later, range(20) t(k)),
     wd AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
     j AS (SELECT wd.doc_id, wd.i, word, gone.i IS NOT NULL AS g FROM wd LEFT JOIN gone ON wd.doc_id = gone.doc_id AND wd.i = gone.i)
SELECT d.doc_id, count(j.i) AS n_words, count(j.i) FILTER (g) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j.i) FILTER (NOT g), '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
}
