"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased; words are runs of letters and digits. Every 3-gram of a test item is a seed. How common a seed is is counted over
all documents, by the different pairs of neighbouring words it occurs between, so that copies of one passage count once. Seeds up to
``RARE`` per word of the corpus (``LEAST`` at least) are rare; an item's three rarest always are. Where two seeds of an item (one, if it has no more)
lie near one diagonal of a document, the item is aligned with the words around it: +2 for equal words, -1 for different ones and for gaps.
The score as a share of the item's best possible score decides. Rarity drops nothing, since many copies of an item that are each edited on their own make all its seeds
common: where common seeds are needed to make two, the words there must first hold as many of the item's words as the least score needs, which every leak does.

Items are taken in blocks of ``BLOCK_WORDS`` words, each with its own pass over the documents, so that what a task holds of the benchmark is bounded.
So are the places that the seeds of a run of texts point to: more than ``PLACES`` are taken in turns, by documents and then by items.

Edge cases: null or empty texts match nothing; an item of fewer than three words is not searched for; null item ids are reported as null, and so are null document ids;
repeated items and documents are each reported by id, once, with the best score; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import Words, documents, mixed, text_chunks

GRAM = 3
RARE = 2e-6
LEAST = 8
SHARE = 0.5
"""An alignment of at least this share of the item's best possible score is a leak."""
SLACK = 8
"""Words by which a diagonal may drift, and by which the aligned part reaches further on either side."""
BLOCK_WORDS = 500_000
PLACES = 1_000_000
BITS = 20


def grams(h: np.ndarray) -> np.ndarray:
    n = max(len(h) - GRAM + 1, 0)
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(g)


@dataclass
class Items:
    """A block of items: word hashes, and for each seed where it occurs."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted, distinct
    first: np.ndarray  # places of seed i: first[i]:first[i + 1]
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray
    table: np.ndarray
    rare: np.ndarray  # by seed

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g that hold a seed, and which."""
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        where = np.searchsorted(self.seeds, g[at])
        same = self.seeds[np.minimum(where, len(self.seeds) - 1)] == g[at] if len(self.seeds) else np.zeros(0, bool)
        return at[same], where[same]

    def places(self, at: np.ndarray, which: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, seed, place) for every place of the seeds found, at most ``most`` in a turn unless one item and document has more; a turn has whole pairs of them."""
        n = len(self.ids)
        key = np.repeat(np.arange(len(self.seeds)), np.diff(self.first)) * n + self.item  # sorted
        turns = [(0, len(at), 0, n)]
        while turns:
            lo, hi, i, j = turns.pop()
            begin, end = (np.searchsorted(key, which[lo:hi] * n + x) for x in (i, j))
            many = end - begin
            total = int(many.sum())
            if not total:
                continue
            first, last = doc[lo], doc[hi - 1]
            if total > most and first < last:
                mid = lo + int(np.searchsorted(doc[lo:hi], (first + last + 1) // 2))
                turns += [(mid, hi, i, j), (lo, mid, i, j)]
            elif total > most and j - i > 1:
                turns += [(lo, hi, (i + j) // 2, j), (lo, hi, i, (i + j) // 2)]
            else:
                use = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(total)
                yield np.repeat(at[lo:hi], many), np.repeat(which[lo:hi], many), use


def items_of(ids: list, texts: list[str]) -> Items:
    """All seeds count as rare at first."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, bare=True)
    h = words.hashes()
    lists = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    per = [grams(x) for x in lists]
    seed = np.concatenate([np.zeros(0, np.uint64), *per])
    item = np.repeat(np.arange(len(per)), [len(g) for g in per])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in per]])
    order = np.argsort(seed, kind="stable")
    seed, item, place = seed[order], item[order], place[order]
    seeds, first = np.unique(seed, return_index=True)
    table = np.zeros(1 << BITS, bool)
    table[(seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True
    need = np.minimum(np.bincount(item, minlength=len(per)), 2)
    return Items(ids, lists, seeds, np.append(first, len(seed)), item, place, need, table, np.ones(len(seeds), bool))


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "folded"):
                words = Words(data, offsets, bare=True)
                h, doc = words.hashes(), words.doc_of_word()
                total += len(h)
                at, which = items.find(grams(h))
                inside = doc[at] == doc[at + GRAM - 1] if len(at) else np.zeros(0, bool)
                at, which = at[inside], which[inside]
                if len(at):
                    before = np.where((at > 0) & (doc[at - 1] == doc[at]), h[at - 1], np.uint64(0))
                    next_at = np.minimum(at + GRAM, len(h) - 1)
                    after = np.where((at + GRAM < len(h)) & (doc[next_at] == doc[at]), h[next_at], np.uint64(0))
                    pair = np.unique(np.stack([which.astype(np.uint64), mixed(before * np.uint64(3) + mixed(after))]), axis=1)
                    yield pa.RecordBatch.from_pydict({"seed": pair[0].astype(np.int64), "context": pair[1].view(np.int64), "words": np.zeros(pair.shape[1], np.int64)})
        yield pa.RecordBatch.from_pydict({"seed": np.array([-1]), "context": np.array([0]), "words": np.array([total])})

    return run


def rare_seeds(docs: DataFrame, items: Items) -> np.ndarray:
    """Which seeds of a block of items are rare; a number per seed comes to the driver."""
    rows = (
        docs.select(F.lower("text").alias("folded")).mapInArrow(_count(items), "seed long, context long, words long")
        .groupBy("seed", "context").agg(F.sum("words").alias("words"))
        .groupBy("seed").agg(F.count("*").alias("contexts"), F.sum("words").alias("words")).collect()
    )
    contexts = np.zeros(len(items.seeds), np.int64)
    total = 0
    for seed, n, words in rows:
        if seed < 0:
            total = words
        else:
            contexts[seed] = n
    rare = contexts <= max(LEAST, RARE * total)
    of_place = np.repeat(np.arange(len(items.seeds)), np.diff(items.first))
    for i in range(len(items.ids)):
        mine = of_place[items.item == i]
        rare[mine[np.argsort(contexts[mine], kind="stable")[:3]]] = True
    return rare


def alignment_scores(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of many pairs of word-hash sequences at once, a row of all matrices per step."""
    rows, width = max(map(len, items)), max(map(len, parts))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.zeros((len(items), width), np.uint64)
    inside = np.zeros((len(items), rows), bool)
    for i, (x, y) in enumerate(zip(items, parts, strict=True)):
        a[i, : len(x)], inside[i, : len(x)] = x, True
        b[i, : len(y)] = y
        b[i, len(y) :] = 1  # no word's hash in practice; padding only lowers scores
    step = np.arange(width)
    h, best = np.zeros((len(items), width + 1), np.int64), np.zeros(len(items), np.int64)
    for r in range(rows):
        turn = np.where((a[:, r : r + 1] == b) & inside[:, r : r + 1], 2, -1)
        new = np.maximum(np.maximum(h[:, :-1] + turn, h[:, 1:] - 1), 0)
        new = np.maximum.accumulate(new + step, axis=1) - step
        h[:, 1:] = new
        best = np.maximum(best, new.max(axis=1))
    return best


def _align(items: Items, share: float, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_chunks(batch, "folded"):
                words = Words(data, offsets, bare=True)
                h, doc = words.hashes(), words.doc_of_word()
                at, which = items.find(grams(h))
                inside = doc[at] == doc[at + GRAM - 1] if len(at) else np.zeros(0, bool)
                at, which = at[inside], which[inside]
                if not len(at):
                    continue
                for at_place, of_seed, use in items.places(at, which, doc[at], PLACES):
                    item, place = items.item[use], items.place[use]
                    owner, diagonal = doc[at_place], at_place - place
                    order = np.lexsort((place, diagonal, item, owner))
                    owner, item, diagonal, place, rare = owner[order], item[order], diagonal[order], place[order], items.rare[of_seed[order]]
                    new = np.ones(len(owner), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > SLACK)
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(owner))
                    seen = (np.cumsum(new) - 1) * (1 << 32) + place
                    spread, of_rare = (np.bincount(np.unique(x) >> 32, minlength=len(first)) for x in (seen, seen[rare]))
                    need = items.need[item[first]]
                    found: dict[tuple[int, int], tuple[int, int]] = {}
                    bounds = []
                    for c in np.flatnonzero(spread >= need):
                        i, d = int(item[first[c]]), int(owner[first[c]])
                        begin = max(int(diagonal[first[c]]) - SLACK, int(words.first[d]))
                        end = min(int(diagonal[last[c] - 1]) + len(items.words[i]) + SLACK, int(words.first[d + 1]))
                        if of_rare[c] < need[c] and 2 * np.isin(items.words[i], h[begin:end]).sum() < share * 2 * len(items.words[i]):
                            continue  # even if all these words were aligned
                        bounds.append((end - begin, d, i, begin, end))
                    bounds.sort()
                    while bounds:
                        many = max(1, min(64, len(bounds), 200_000 // max(bounds[-1][0], 1)))  # bounded matrices, widest first
                        some, bounds = bounds[-many:], bounds[:-many]
                        scores = alignment_scores([items.words[x[2]] for x in some], [h[x[3] : x[4]] for x in some])
                        for (_, d, i, begin, _), score in zip(some, scores, strict=True):
                            if score >= share * 2 * len(items.words[i]):
                                found[d, i] = max(found.get((d, i), (0, 0)), (int(score), int(words.first[d]) - begin))
                    if found:
                        pairs = sorted(found)
                        rows = pa.array([lo + d for d, _ in pairs])
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[batch.column(k).take(rows) for k in keys],
                                pa.array([items.ids[i] for _, i in pairs], pa.int64()),
                                pa.array([found[p][0] for p in pairs], pa.int64()),
                                pa.array([found[p][0] / (2 * len(items.words[p[1]])) for p in pairs], pa.float64()),
                                pa.array([-found[p][1] for p in pairs], pa.int64()),
                            ],
                            names=[*keys, "item_id", "score", "share", "near_word"],
                        )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` of the document, item_id, score, share, near_word (where the aligned part of the document begins, in its words): one row for each leaked item of a document."""
    spark, keys = docs.sparkSession, list(keys)
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys) + ", item_id long, score long, share double, near_word long"
    sized = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_WORDS * 6)))
    found = None
    for block in range(blocks):
        rows = [r for r in sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select("item_id", "text").collect()]
        items = items_of([r.item_id for r in rows], [r.text for r in rows])
        if not len(items.seeds):
            continue
        items.rare = rare_seeds(docs, items)
        part = docs.select(*keys, F.lower("text").alias("folded")).mapInArrow(_align(items, share, keys), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "share", (-F.col("near_word")).alias("w"))).alias("m")
    return found.groupBy(*keys, "item_id").agg(best).select(*keys, "item_id", "m.score", "m.share", (-F.col("m.w")).alias("near_word"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontamination": op7}
