"""Hard negatives of anchors, with exact windows, by a vertical scan that drops candidates dimension by dimension.

Vectors lie column by column in packs of ``PACK`` rows with each column's least and largest value. For an anchor the
columns are read in order of its descending magnitudes. After each step a row's score lies between its partial sum plus
the least, and plus the largest, that the unread columns can still give; rows whose interval can't matter any more leave
the candidate bitmap. Positives: rows of the anchor's label whose upper end reaches the k-th best lower end. Negatives:
rows of other labels whose interval meets the window of some positive, and isn't below the ``negatives`` best lower ends
that are surely inside it. What was found in one pack raises the bounds for the next one. Rows that last to the end have
their exact scores, so the result doesn't depend on packs.

Packs of one part of the rows (about ``PART`` rows: a share of one large label, or several small labels) meet anchors in
blocks of about ``ANCHORS``; positives only look at the parts of their label. A part returns as many rows per anchor as
are wanted, and a window per anchor merges the parts. Parts and blocks are dealt by a hash of the row, so that neither a
label nor a vector with many copies fills one task.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
length are not compared; rows with an anchor's id are neither its positives nor its negatives, and rows that repeat an
id are rows of their own; anchors without positives, and positives without negatives in their window, give no row;
vectors without components score 0; scores are computed exactly and one beyond 64 bits counts as the nearest long;
empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

PACK = 8192
PART = 32768
ANCHORS = 4096
"""Rows of a pack at most; rows of a part and anchors of a block on average."""
STEP = 8
"""Columns read between two looks at the candidates."""
EXACT = 1 << 53
LONG = (1 << 63) - 1
CELL = ["dims", "kind", "slot", "part"]
PACKS = "dims int, kind int, slot long, part long, width string, ids binary, labels binary, columns binary"


def scored_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(row, id, label, v, dims) of the rows that take part; ``row`` tells rows with one id apart."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    v = F.col(vector_col).cast("array<double>")
    return found.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.size(v).alias("dims"))


def placed(rows: DataFrame, size: int = PART) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the cell (kind, slot, part) they lie in, and (dims, label, kind, slot, parts) of each label.

    A label of ``size`` rows or more is dealt over parts of its own; smaller ones share parts by a hash of the label.
    """
    counts = rows.groupBy("dims", "label").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < size).groupBy("dims").agg(F.ceil(F.sum("n") / size).cast("long").alias("slots"))
    own = F.col("n") >= size
    slot = F.when(own, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.col("slots")))
    labels = stored(counts.join(small, "dims", "left").select("dims", "label", F.when(own, 1).otherwise(0).alias("kind"), slot.alias("slot"), F.when(own, F.ceil(F.col("n") / size)).otherwise(1).cast("long").alias("parts")), "bond-labels")
    return rows.join(labels, ["dims", "label"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))), labels


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


def _packer(size: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"), key[0].as_py())
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        made: dict[str, list] = {n: [] for n in ("width", "ids", "labels", "columns")}
        for lo in range(0, len(ids), size):
            part = x[lo : lo + size].T
            with np.errstate(over="ignore"):
                whole = np.floor(part * 256)
            most = np.abs(whole).max(initial=0)
            width = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "raw"
            cells = np.ascontiguousarray(part if width == "raw" else whole.astype(width))
            for n, v in zip(made, (width, ids[lo : lo + size].tobytes(), labels[lo : lo + size].tobytes(), cells.tobytes()), strict=True):
                made[n].append(v)
        same = {n: pa.array([k.as_py()] * len(made["ids"]), t) for n, k, t in zip(CELL, key, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)}
        return pa.table({**same, "width": pa.array(made["width"], pa.string()), **{n: pa.array(made[n], pa.binary()) for n in ("ids", "labels", "columns")}})

    return pack


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): as doubles where they hold it, else as Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * 256)
    if np.abs(v).max(initial=0) < EXACT:
        return v
    exact = [math.floor(a * 256) if abs(a) < EXACT / 256 else int(a) * 256 for a in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


class Pack:
    """Columns of some rows, with the bounds of each."""

    def __init__(self, dims: int, width: str, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        cells = np.frombuffer(columns, np.float64 if width == "raw" else width).reshape(dims, len(self.ids))
        self.x = whole_numbers(cells) if width == "raw" else cells.astype(np.float64)
        self.low, self.high = (self.x.min(axis=1), self.x.max(axis=1)) if dims else (np.zeros(0), np.zeros(0))
        self.most = max((abs(int(v)) for v in (*self.low, *self.high)), default=0)

    def scan(self, q: np.ndarray, alive: np.ndarray, narrow: Callable[[object, object], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of what is left of the bitmap ``alive``; ``narrow`` judges lower and upper ends."""
        x, dims = self.x, len(q)
        if dims * self.most * int(np.abs(q).max(initial=0)) >= EXACT:
            q, x = (np.array([int(v) for v in a.ravel().tolist()] + [None], object)[:-1].reshape(a.shape) for a in (q, x))
        order = np.argsort(-np.abs(q), kind="stable")
        ends = [q * self.low, q * self.high] if x.dtype != object else [q * np.array([int(v) for v in a] + [None], object)[:-1] for a in (self.low, self.high)]
        zero = np.zeros(1, x.dtype)
        least = np.concatenate([np.cumsum(np.minimum(*ends)[order][::-1])[::-1], zero])
        most = np.concatenate([np.cumsum(np.maximum(*ends)[order][::-1])[::-1], zero])
        rows = np.flatnonzero(alive)
        sums = np.zeros(len(rows), x.dtype)
        for a in range(0, dims, STEP):
            read = order[a : a + STEP]
            if 4 * len(rows) > len(alive):
                sums = sums + (q[read] @ x[read])[rows]
            else:
                sums = sums + q[read] @ x[np.ix_(read, rows)]
            upto = a + len(read)
            keep = narrow(sums + least[upto], sums + most[upto])
            if not keep.all():
                alive[rows[~keep]] = False
                rows, sums = rows[keep], sums[keep]
            if not len(rows):
                break
        return rows, sums


def _kth(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, -k)[-k]


def _clamped(score: object) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def _merged(top: list, ids: np.ndarray, scores: np.ndarray, k: int) -> list:
    """The k best of (-score, id), smaller ids first among equals."""
    if len(ids) > k:
        best = scores >= _kth(scores, k)
        ids, scores = ids[best], scores[best]
    return sorted([*top, *((-_clamped(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True))])[:k]


def best_of_label(packs: list[Pack], anchor_id: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of the anchor's label, without rows of its id."""
    top: list[tuple[int, int]] = []
    for pack in packs:
        floor = [-top[-1][0] if len(top) == k else None]

        def narrow(low: np.ndarray, high: np.ndarray, floor: list = floor) -> np.ndarray:
            if len(low) >= k:
                reached = _kth(low, k)
                floor[0] = reached if floor[0] is None else max(floor[0], reached)
            return np.ones(len(low), bool) if floor[0] is None else (high >= floor[0]).astype(bool)

        rows, scores = pack.scan(q, (pack.labels == label) & (pack.ids != anchor_id), narrow)
        top = _merged(top, pack.ids[rows], scores, k)
    return [(-s, i) for s, i in top]


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """The scores s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def inside_windows(packs: list[Pack], anchor_id: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window the (score, id) of the k best rows of other labels in it."""
    tops: list[list[tuple[int, int]]] = [[] for _ in windows]
    open_ones = [j for j, (a, b) in enumerate(windows) if a <= b]
    for pack in packs if open_ones else ():
        floors = {j: max(windows[j][0], -tops[j][-1][0]) if len(tops[j]) == k else windows[j][0] for j in open_ones}

        def narrow(low: np.ndarray, high: np.ndarray, floors: dict = floors) -> np.ndarray:
            keep = np.zeros(len(low), bool)
            for j in open_ones:
                sure = low[(low >= floors[j]).astype(bool) & (high <= windows[j][1]).astype(bool)]
                if len(sure) >= k:
                    floors[j] = max(floors[j], _kth(sure, k))
                keep |= (high >= floors[j]).astype(bool) & (low <= windows[j][1]).astype(bool)
            return keep

        rows, scores = pack.scan(q, (pack.labels != label) & (pack.ids != anchor_id), narrow)
        for j in open_ones:
            fits = (scores >= windows[j][0]).astype(bool) & (scores <= windows[j][1]).astype(bool)
            tops[j] = _merged(tops[j], pack.ids[rows][fits], scores[fits], k)
    return [[(-s, i) for s, i in top] for top in tops]


def _cells(judge: Callable[[list[Pack], dict, np.ndarray], Iterator[tuple]], names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if len(left) and len(right):
            dims = left.column("dims")[0].as_py()
            right = right.rename_columns([c.removeprefix("a_") for c in right.column_names])
            packs = [Pack(dims, *(row[n] for n in ("width", "ids", "labels", "columns"))) for row in left.to_pylist()]
            vectors = _matrix(right.column("v"), dims)
            for row, x in zip(right.drop_columns(["v"]).to_pylist(), vectors, strict=True):
                for found in judge(packs, row, whole_numbers(x)):
                    for column, value in zip(out, found, strict=True):
                        column.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out, strict=True)})

    return run


def _met(packs: DataFrame, anchors: DataFrame, by: list[str], judge: Callable, names: list[str], size: int) -> DataFrame:
    """What ``judge`` finds for the packs of a cell and a block of its anchors; ``anchors`` have the columns of a cell. Blocks are counted by ``by``."""
    blocks = anchors.select("row", *by).distinct().groupBy(*by).agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    left = packs.join(blocks, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = anchors.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    right = right.toDF(*[f"a_{c}" for c in right.columns])  # packs come from the same rows
    schema = ", ".join(f"{n} long" for n in names)
    return left.groupBy(*CELL, "block").cogroup(right.groupBy(*[f"a_{c}" for c in (*CELL, "block")])).applyInArrow(_cells(judge, names), schema)


def _ranked(found: DataFrame, by: list[str], id_col: str, score: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", part: int = PART, pack: int = PACK, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where ``is_anchor(id)`` and each of its ``positives`` best rows of the same label: the ``negatives``
    best rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's.
    """
    taken = stored(scored_rows(rows, id_col, label_col, vector_col), "bond-rows")
    lying, labels = placed(taken, part)
    packs = stored(lying.select(*CELL, "id", "label", "v").groupBy(*CELL).applyInArrow(_packer(pack), PACKS), "bond-packs")
    anchors = taken.where(is_anchor(F.col("id"))).select("row", "id", "label", "v", "dims")

    def positive(held: list[Pack], a: dict, q: np.ndarray) -> Iterator[tuple]:
        for score, i in best_of_label(held, a["id"], a["label"], q, positives):
            yield a["row"], i, score

    def negative(held: list[Pack], a: dict, q: np.ndarray) -> Iterator[tuple]:
        found = inside_windows(held, a["id"], a["label"], q, [window(s, least, most) for s in a["scores"]], negatives)
        for place, (positive_id, score, top) in enumerate(zip(a["positives"], a["scores"], found, strict=True)):
            for s, i in top:
                yield a["row"], a["id"], place, positive_id, score, i, s

    at_home = anchors.join(labels, ["dims", "label"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    near = _ranked(_met(packs, at_home, ["dims", "kind", "slot"], positive, ["row", "id", "score"], block), ["row"], "id", "score", positives, "place")
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))  # at most ``positives``
    asked = stored(anchors.join(listed.select("row", F.col("p.id").alias("positives"), F.col("p.score").alias("scores")), "row"), "bond-anchors")
    everywhere = asked.join(packs.select(*CELL).distinct(), "dims")
    names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _ranked(_met(packs, everywhere, ["dims"], negative, names, block), ["row", "place"], "negative_id", "negative_score", negatives, "rank")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", relabelled), lambda i: i % 50 == 0)


QUERIES = {"op13_hard_negatives": op13}
SQL = {
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
}
