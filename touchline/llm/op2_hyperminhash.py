r"""Near-duplicates by HyperMinHash, banding and verification on the full shingle sets.

A set's 64-bit shingle hashes fall into ``BUCKETS`` buckets; a bucket keeps its smallest hash as a register of
leading-zero count and ten mantissa bits. Empty registers borrow from others by a fixed order, so that small sets fill all of them.
Texts of equal word sequences are one class and need no comparing. Four registers make a band; classes that share a band are candidates. In each band's
group the most central class (that with the most companions over all its bands) is the pivot, compared with every other member, which is linear in the group.
The collision-corrected Jaccard estimate (six standard deviations of slack) rules out links; the words themselves confirm them.

Other pairs of a group are never all formed. A member differs from its pivot by a set of added and missing shingles, and two members differ by the
symmetric difference of these sets. So a link that the pivot doesn't imply needs common differences. Ordered by how rare they are in the group, one of these stands early
in both lists (prefix filtering, which loses nothing), and differences that a whole family has come last: members that share an early difference are a cell. A large cell is first compared with
pivots of its own, so that families fall together, and only members of different components are paired then. Candidates that
still lie in different components pass the estimate and are compared as well.

With 32 bands of four registers a pair at the threshold 0.85 is missed with probability 1e-10, at 0.8 with 1e-7.

Edge cases: a null text, or one without words, has an empty set, is its own component and kept; fewer words than a
shingle form one shingle; a null id takes no part, has a null component and is kept; rows that repeat an id are judged by
their own texts; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import Words, documents, mixed, range_hashes, stored, text_chunks

BUCKETS = 128
ROWS = 4
MANTISSA = 10
CELL_ROUNDS = 2
LARGE = 16
"""Cells of more members are compared with a pivot of their own first, in so many rounds."""
COLLISION = 1 / (3 * (1 << MANTISSA))
"""Chance that different minima give equal registers: equal leading zeros (1/3), then equal mantissas."""


def _borrow_order() -> np.ndarray:
    """For each attempt and bucket, the bucket to borrow from."""
    key = mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(977)).reshape(BUCKETS, BUCKETS)
    return np.argsort(key, axis=1).T


def registers(doc: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """HyperMinHash registers (docs x BUCKETS) of distinct shingle hashes; a row without shingles is zero."""
    bits = BUCKETS.bit_length() - 1
    least = np.full(docs * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    np.minimum.at(least, doc * BUCKETS + bucket, hashes << np.uint64(bits))
    filled = np.zeros(docs * BUCKETS, bool)
    filled[doc * BUCKETS + bucket] = True
    length = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    zeros = (53 - length).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    found = np.where(filled, ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa, 0).astype(np.uint16).reshape(docs, BUCKETS)
    out, order = found.copy(), _borrow_order()
    row, column = np.nonzero((found == 0) & (found.max(axis=1, initial=0) > 0)[:, None])
    for attempt in order:
        if not len(row):
            break
        lent = found[row, attempt[column]]
        got = lent > 0
        out[row[got], column[got]] = lent[got]
        row, column = row[~got], column[~got]
    return out


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of consecutive texts."""
    h, doc = words.hashes(), words.doc_of_word()
    n = len(h)
    starts = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    x = range_hashes(h, np.concatenate([starts, words.first[short]]), np.concatenate([starts + k, words.first[short + 1]]))
    d = np.concatenate([doc[starts], short])
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return d[new], x[new]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the words, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in text_chunks(batch):
                d, x = shingle_hashes(Words(data, offsets, fold=True), k)
                n = np.bincount(d, minlength=hi - lo)
                raw = data.tobytes()
                digests = [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
                regs = registers(d, x, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "regs"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, regs binary")


def banded(classes: DataFrame) -> DataFrame:
    """(band, id): 64-bit keys of each class's bands."""
    width = ROWS * 2
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BUCKETS // ROWS)])
    return classes.select(F.explode(keys).alias("band"), "id")


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b"))
            raw = (a == b).mean(axis=1) if len(a) else np.zeros(0)
            jaccard = (raw - COLLISION) / (1 - COLLISION)
            smaller, larger = (f(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) for f in (np.minimum, np.maximum))
            t = percent / 100
            likely = (jaccard >= t - 6 * np.sqrt(t * (1 - t) / np.minimum(smaller, BUCKETS))) & (smaller * 100 >= larger * percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(likely, pa.bool_())], names=["a", "b", "likely"])

    return run


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) of class ids with ``likely``: whether sizes and registers allow a link."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n").alias(f"n_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(_estimate(percent), "a long, b long, likely boolean")


def _shingle_set(text: str, k: int) -> set:
    words = (text or "").encode().lower().split()  # bytes.lower folds A-Z only
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def _compare(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple | None, set] = (None, set())
        for batch in batches:
            rows: list[tuple] = []
            ids, left, right, likely = (batch.column(c) for c in ("a", "text_a", "text_b", "likely"))
            for i in range(batch.num_rows):
                a, text = ids[i].as_py(), left[i].as_py()
                if held[0] != (a, hash(text)):
                    held = ((a, hash(text)), _shingle_set(text, k))
                pivot, other = held[1], _shingle_set(right[i].as_py(), k)
                both = len(pivot & other)
                apart = len(pivot) + len(other) - 2 * both
                linked = likely[i].as_py() and both > 0 and 100 * both >= percent * (both + apart)
                differ = [xxhash.xxh64_intdigest(b" ".join(x)) - (1 << 63) for x in pivot ^ other]
                rows.append((a, batch.column("b")[i].as_py(), linked, len(other), apart, differ))
            names = ["a", "b", "linked", "n", "apart", "differ"]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    return run


def compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, likely) with ``linked``, the size of b's set, by how many shingles the sets differ, and hashes of these."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "likely", "text_a", "text_b").mapInArrow(_compare(k, percent), "a long, b long, linked boolean, n long, apart long, differ array<long>")


def cells(measured: DataFrame, percent: int) -> DataFrame:
    """(a, e, b, linked, n, apart, at): the early differences e of the members b of each pivot a that has members without a link; ``at`` is their place in b's list, rarest first."""
    groups = stored(measured.where(~F.col("linked")).select("a").distinct(), "open-groups")
    each = stored(measured.join(groups, "a", "left_semi").select("a", "b", "linked", "n", "apart", F.explode("differ").alias("e")), "differences")
    often = each.groupBy("a", "e").agg(F.count("*").alias("often"))
    placed = each.join(often, ["a", "e"]).withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "e")) - 1)
    # of two linked sets, each has the first common difference within this many places
    room = (100 - percent) * (F.col("n") + F.col("n") * 100 / percent) / (100 + percent)
    early = placed.where((F.col("at") <= room) & (F.col("often") > 1))
    return stored(early.select("a", "e", "b", "linked", "n", "apart", "at"), "cells")


def cell_stars(found: DataFrame, rooted: DataFrame, before: DataFrame | None) -> DataFrame:
    """(a, b): in each large cell the member nearest to the group's pivot that was no pivot ``before``, and each other one of another component."""
    rows = found.join(rooted.withColumnRenamed("id", "b"), "b", "left").select("a", "e", "b", "apart", F.coalesce("root", "b").alias("root"))
    free = rows if before is None else rows.join(before.select("b").distinct(), "b", "left_anti")
    size = rows.groupBy("a", "e").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("members") > LARGE) & (F.col("low") < F.col("high")))
    pivots = free.join(size, ["a", "e"]).groupBy("a", "e").agg(F.min(F.struct("apart", "b", "root")).alias("p")).select("a", "e", F.col("p.b").alias("p"), F.col("p.root").alias("p_root"))
    star = rows.join(pivots, ["a", "e"]).where(F.col("root") != F.col("p_root"))
    return star.select(F.col("p").alias("a"), "b").distinct()


def cell_pairs(found: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one cell that may be linked and lie in different components."""
    rows = found.join(rooted.withColumnRenamed("id", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    x = rows.where(~F.col("linked")).select("a", "e", *[F.col(c).alias(f"{c}_x") for c in ("b", "n", "apart", "root", "at")])
    y = rows.select("a", "e", *[F.col(c).alias(f"{c}_y") for c in ("b", "n", "apart", "root", "at")])
    room = (F.col("n_x") + F.col("n_y")) * (100 - percent)
    early_x = (F.col("at_x") * 2 - F.col("apart_x") + F.col("apart_y")) * (100 + percent) <= room
    early_y = (F.col("at_y") * 2 - F.col("apart_y") + F.col("apart_x")) * (100 + percent) <= room
    fits = (F.col("root_x") != F.col("root_y")) & early_x & early_y & _similar_size(F.col("n_x"), F.col("n_y"), percent)
    return x.join(y, ["a", "e"]).where(fits).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no u is another one's v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(id, root): each linked id with the smallest id it can reach, by alternating large and small stars until each component is one star around its smallest id."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "small-star")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def joined_components(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` after further links: only the roots that these join are searched anew."""

    def root_of(links: DataFrame, end: str) -> DataFrame:
        return links.join(rooted.select(F.col("id").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")

    moved = components(root_of(root_of(links, "a"), "b"))
    kept = rooted.join(moved.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return stored(kept.union(moved), "joined-components")  # a root is no id of ``rooted``


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, distinct_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) for each row of ``docs``.

    ``distinct_ids``: the caller knows that no id stands for different texts, so this isn't looked for.
    """
    if distinct_ids:
        return _near_duplicates(docs, k, percent)
    hashed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"))
    shared = hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    return _with_own_keys(docs, k, percent) if shared.limit(1).count() else _near_duplicates(docs, k, percent)


def _with_own_keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The same where an id stands for different texts: each id and text is compared under a key of its own."""
    keys = stored(docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash")).distinct().withColumn("key", F.monotonically_increasing_id()), "row-keys")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(keys, ["doc_id", "text_hash"], "left")
    found = stored(_near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("root"), "text_hash"), "keyed-components")
    named = found.join(keys.select("key", "doc_id"), "key", "left")
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(least, "root", "left")
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    signed = stored(signatures(docs, k), "signatures")
    classes = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "regs")).alias("m")).select("k1", "k2", F.col("n_shingles").alias("n"), F.col("m.doc_id").alias("id"), F.col("m.regs").alias("regs")),
        "classes",
    )
    bands = stored(banded(classes), "bands")
    sizes = stored(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "band-sizes")
    shared = bands.join(sizes, "band")
    central = shared.groupBy("id").agg(F.sum("members").alias("central"))
    members = stored(shared.select("band", "id").join(central, "id"), "members")
    # the texts of all classes that share a band, selected once; a merge join at any size, so that its cost is in proportion
    companions = members.select(F.col("id").alias("doc_id")).distinct()
    texts = stored(docs.select("doc_id", "text").join(companions.hint("merge"), "doc_id", "left_semi"), "texts")
    pivots = members.groupBy("band").agg(F.max(F.struct("central", (-F.col("id")).alias("id"))).alias("p")).select("band", (-F.col("p.id")).alias("a"))
    star = members.join(pivots, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    measured = stored(compared(stored(estimated(star, classes, percent), "star-pairs"), texts, k, percent), "measured")
    rooted = components(measured.where("linked").select("a", "b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = stored(estimated(pairs, classes, percent).where("likely"), "other-likely")
        return stored(compared(likely, texts, k, percent).where("linked").select("a", "b"), "more-links")

    found = cells(measured, percent)
    stars = None
    for _ in range(CELL_ROUNDS):
        star = stored(cell_stars(found, rooted, stars), "cell-stars")
        if not star.limit(1).count():
            break
        stars = star.select(F.col("a").alias("b")) if stars is None else stars.unionByName(star.select(F.col("a").alias("b")))
        more = confirmed(star)
        if not more.limit(1).count():
            break
        rooted = joined_components(rooted, more)
    rest = stored(cell_pairs(found, rooted, percent), "other-pairs")
    if rest.limit(1).count():
        more = confirmed(rest)
        if more.limit(1).count():
            rooted = joined_components(rooted, more)
    labelled = classes.select("k1", "k2", F.col("n").alias("n_shingles"), "id").join(rooted, "id", "left").select("k1", "k2", "n_shingles", F.coalesce("root", "id").alias("root"))
    joined = signed.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(labelled, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=85).drop("text_hash")


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


QUERIES = {"op2_hyperminhash": op2}
SQL = {"op2_hyperminhash": _sql()}
