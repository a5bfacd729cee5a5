"""Exact top-k by inner product with a paged M-tree and best-first search.

Maximal inner product becomes nearest neighbour in a metric space: with M the largest norm, every row x gets one
more component sqrt(M^2 - |x|^2) and every query a zero, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Rows go to the
nearest of a bounded number of routing objects; nodes are packed into shelves of about ``SHELF`` rows (a node with
more rows is split), and each shelf holds a tree: routing objects with covering radii, leaf pages with their distance
to the routing object, entries sorted by their distance to the page's pivot. A query visits nodes by lower bound
and skips pages and entries by the stored distances (triangle inequality). Queries meet shelves in bounded blocks; each
cell returns k rows per query, a window merges them.

Scores are integers and ties go to the smaller id, so the result is exact whatever the tree looks like.

Edge cases: a row with a null id, null vector, or a null or non-finite component takes no part; rows of different
length are not compared; repeated ids are separate rows, all left out as candidates of a query with that id; a query
with fewer than k candidates returns them all; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

ROUTING = 256
SHELF = 16384
PAGE = 128
QUERY_BLOCK = 1024
"""Routing objects; rows of a shelf, entries of a leaf page, and queries of a block, on average."""


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dims, norm2) of the rows that take part; v holds floor(256 * x)."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("long"))
    found = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return found.select("id", "v", F.size("v").alias("dims"), norm.alias("norm2"))


def routed(rows: DataFrame, pivots: dict[int, np.ndarray], norms: dict[int, float]) -> DataFrame:
    """``rows`` with ``node``: the nearest routing object of the same length, -1 where there is none."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            node = np.full(len(dims), -1, np.int32)
            for d in np.unique(dims):
                if d in pivots:
                    mine = np.flatnonzero(dims == d)
                    x = _lift(_matrix(batch.column("v").take(pa.array(mine)), int(d)), norms[d])
                    node[mine] = (x @ pivots[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, "node"])

    return rows.select("id", "v", "dims").mapInArrow(run, "id long, v array<long>, dims int, node int")


PAGES = "dims int, shelf long, ids binary, vectors binary, entry_parent binary, page_from binary, page_node binary, page_radius binary, page_parent binary, nodes binary, node_radius binary, norm2 double"


def _build(pivots: dict[int, np.ndarray], norms: dict[int, float]):
    def build(key, table):
        dims, shelf = key[0].as_py(), key[1].as_py()
        norm2 = norms[dims]
        x = _matrix(table.column("v"), dims)
        ids, node = table.column("id").to_numpy(), table.column("node").to_numpy()
        up = _lift(x, norm2)
        order, starts, owner, radius, parent, entry, places, reach = [], [], [], [], [], [], [], []
        for n, label in enumerate(np.unique(node)):
            mine = np.flatnonzero(node == label)
            place = pivots[dims][label] if label >= 0 else np.zeros(dims + 1)
            far = np.linalg.norm(up[mine] - place, axis=1)
            places.append(place)
            reach.append(far.max())
            # neighbours by the direction of largest spread share a page
            centred = up[mine] - up[mine].mean(axis=0)
            axis = np.linalg.svd(centred[:: max(1, len(mine) // 512)], full_matrices=False)[2][0]
            for part in np.array_split(mine[np.argsort(centred @ axis, kind="stable")], -(-len(mine) // PAGE)):
                pivot = part[np.linalg.norm(up[part] - up[part].mean(axis=0), axis=1).argmin()]
                d = np.linalg.norm(up[part] - up[pivot], axis=1)
                by = np.argsort(d, kind="stable")  # the pivot itself comes first, at distance 0
                starts.append(len(entry))
                order.extend(part[by])
                entry.extend(d[by])
                owner.append(n)
                radius.append(d.max())
                parent.append(np.linalg.norm(up[pivot] - place))
        starts.append(len(entry))
        cells = [ids[order].astype(np.int64), x[order].astype(np.int64), np.array(entry), np.array(starts, np.int64), np.array(owner, np.int64), np.array(radius), np.array(parent), np.array(places), np.array(reach)]
        names = ["ids", "vectors", "entry_parent", "page_from", "page_node", "page_radius", "page_parent", "nodes", "node_radius"]
        return pa.table({"dims": pa.array([dims], pa.int32()), "shelf": pa.array([shelf], pa.int64()), **{k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(names, cells, strict=True)}, "norm2": [norm2]})

    return build


class Shelf:
    """A shelf's tree, read from its row."""

    def __init__(self, row: dict):
        read = lambda k, t=np.float64: np.frombuffer(row[k], t)
        dims = row["dims"]
        self.ids, self.norm2 = read("ids", np.int64), row["norm2"]
        self.exact = read("vectors", np.int64).reshape(-1, dims)
        self.big = bool(len(self.exact) and np.abs(self.exact).max() >= 1 << 20)
        self.x = self.exact.astype(np.float64)
        self.up = _lift(self.exact, self.norm2)
        self.entry, self.start, self.owner = read("entry_parent"), read("page_from", np.int64), read("page_node", np.int64)
        self.radius, self.parent, self.reach = read("page_radius"), read("page_parent"), read("node_radius")
        self.nodes = read("nodes").reshape(-1, dims + 1)
        self.pages_of = [np.flatnonzero(self.owner == n) for n in range(len(self.reach))]

    def scores(self, lo: int, hi: int, q: np.ndarray) -> np.ndarray:
        if self.big or np.abs(q).max(initial=0) >= 1 << 20:
            return np.array([sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in self.exact[lo:hi]], object)
        return (self.x[lo:hi] @ q.astype(np.float64)).astype(np.int64)

    def best(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own: best first by lower bound."""
        square = float(np.dot(q.astype(np.float64), q.astype(np.float64)))
        at = np.append(q.astype(np.float64), 0.0)
        slack = 1e-6 * (1 + np.sqrt(square) + np.sqrt(self.norm2))
        to_node = np.linalg.norm(self.nodes - at, axis=1)
        heap = [(float(max(b, 0)), 0, n, 0.0) for n, b in enumerate(to_node - self.reach)]
        heapq.heapify(heap)
        top: list[tuple[int, int]] = []  # (-score, id), sorted
        limit = np.inf
        while heap:
            bound, kind, n, d = heapq.heappop(heap)
            if bound > limit:
                break
            if kind == 0:
                pages = self.pages_of[n]
                pages = pages[np.abs(to_node[n] - self.parent[pages]) - self.radius[pages] <= limit]
                far = np.linalg.norm(self.up[self.start[pages]] - at, axis=1)
                for p, e in zip(pages, far, strict=True):
                    if e - self.radius[p] <= limit:
                        heapq.heappush(heap, (float(max(e - self.radius[p], 0)), 1, int(p), float(e)))
                continue
            a, b = self.start[n], self.start[n + 1]
            lo, hi = a + np.searchsorted(self.entry[a:b], d - limit), a + np.searchsorted(self.entry[a:b], d + limit, "right")
            if lo >= hi:
                continue
            got = self.scores(lo, hi, q)
            keep = np.flatnonzero(got >= -top[-1][0]) if len(top) == k else np.arange(hi - lo)
            if not len(keep):
                continue
            ids = self.ids[lo:hi][keep]
            top = sorted([*top, *((-int(s), int(i)) for s, i in zip(got[keep], ids, strict=True) if i != query_id)])[:k]
            if len(top) == k:
                limit = np.sqrt(max(square + self.norm2 + 2.0 * top[-1][0], 0.0)) + slack
        return [(-s, i) for s, i in top]


def _search(k: int):
    def run(left, right):
        out: list[list[int]] = [[], [], [], []]
        for row in left.to_pylist():
            shelf = Shelf(row)
            if len(right):
                for key, query_id, q in zip(right.column("query_row").to_pylist(), right.column("id").to_pylist(), _matrix(right.column("v"), row["dims"]), strict=True):
                    for score, i in shelf.best(query_id, q, k):
                        for column, value in zip(out, (key, query_id, i, score), strict=True):
                            column.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_row", "query_id", "vec_id", "score"), out, strict=True)})

    return run


def build_pages(rows: DataFrame) -> DataFrame:
    """The stored tree: a row per shelf. ``rows``: id, v, dims, norm2."""
    norms = {d: float(n) for d, n in rows.groupBy("dims").agg(F.max("norm2")).collect()}
    sample = rows.orderBy(F.xxhash64("v"), "id").limit(ROUTING).select("dims", "v").collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {r.dims for r in sample}:
        x = np.unique(np.array([r.v for r in sample if r.dims == d], np.int64).reshape(-1, d), axis=0)
        pivots[d] = _lift(x, norms[d])
    assigned = stored(routed(rows, pivots, norms), "mtree-rows")
    w = Window.partitionBy("dims").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    counts = assigned.groupBy("dims", "node").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
    span = counts.select("dims", "node", F.floor((F.col("upto") - F.col("n")) / SHELF).alias("lo"), F.floor((F.col("upto") - 1) / SHELF).alias("hi"))
    # as many rows as there are routing objects
    placed = assigned.join(F.broadcast(span), ["dims", "node"]).withColumn("shelf", F.col("lo") + F.pmod(F.xxhash64("id", "v"), F.col("hi") - F.col("lo") + 1))
    return stored(placed.select("dims", "shelf", "node", "id", "v").groupBy("dims", "shelf").applyInArrow(_build(pivots, norms), PAGES), "mtree-pages")


def top_k(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row where ``is_query(id)``."""
    vectors = stored(integer_vectors(rows, id_col, vector_col), "mtree-vectors")
    pages = build_pages(vectors)
    asked = vectors.where(is_query(F.col("id")))
    blocks = asked.groupBy("dims").agg(F.count("*").alias("n")).select("dims", F.ceil(F.col("n") / QUERY_BLOCK).cast("long").alias("blocks"))
    queries = stored(asked.join(F.broadcast(blocks), "dims").select("id", "v", "dims", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("block"), F.monotonically_increasing_id().alias("query_row")), "mtree-queries")
    cells = pages.select("dims", "shelf").join(queries.select("dims", "block").distinct(), "dims")  # ids of shelves and blocks only
    left = pages.join(cells, ["dims", "shelf"]).toDF(*pages.columns, "block").groupBy("dims", "shelf", "block")
    asked_of = queries.join(cells, ["dims", "block"]).select("dims", "shelf", "block", "query_row", "id", "v")
    right = asked_of.toDF("dims_q", "shelf_q", "block_q", "query_row", "id", "v").groupBy("dims_q", "shelf_q", "block_q")
    found = left.cogroup(right).applyInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, 5)


QUERIES = {"op4_mtree_topk": op4}
SQL = {
    "op4_mtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 5
"""
}
