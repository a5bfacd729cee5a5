"""Work on all pairs of a pool in cells: one block of rows meets one block of the same pool, as one group of a shuffle.

Inside a cell numpy does the arithmetic of ``similarity`` in the same order, so that both give the same doubles; what leaves a cell
is the k best of a row, counts or sums, never its pairs. A cell holds two blocks, whatever the size of a pool.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.scratch import stored

BLOCK = 16384
"""Rows of a block on average, at most."""
NEAR = 131072
"""The same for nearest rows, which need only some matrices of both blocks: a pool of fewer rows is one cell, if there are many pools."""
CELLS, LEAST = 64, 256
"""Blocks are made smaller, but not below ``LEAST`` rows, where there would be fewer cells."""
LEFT, RIGHT, BOTH = 0, 1, 2
"""Sides of a cell that a row is on; a block that meets itself is sent once."""
LEAF, SEEN = 64, 512
"""Rows of a leaf, and rows that give a first limit; leaves beyond it are passed over as a whole."""
ASKED, MET = 256, 4096
"""Rows that look for their neighbours together, and rows that they meet at a time."""
SPARE = 4e-6
"""More than a product of few numbers in single precision can be off by, in proportion to their squares."""
SLACK = 1e-8
"""More than nine digits and rounding errors can move a bound."""


def in_cells(rows: DataFrame, key: str, pools: list[str], others: list[str], work: Callable, schema: str, block: int = BLOCK, once: bool = False) -> DataFrame:
    """Pools and columns of ``schema``: what ``work(left, right)`` makes of the two Arrow tables of each cell, as a dict of Arrow arrays.

    ``once``: two blocks meet once, not also the other way round. Rows without key or pool meet nobody.
    """
    kept = rows.select(*pools, key, *others).dropna(subset=[*pools, key])
    sizes = kept.groupBy(*pools).agg(F.count("*").alias("_n"))
    count = sizes.agg(F.count("*").alias("_pools"))
    wanted = F.ceil(F.sqrt(F.lit(CELLS) / F.col("_pools")))
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.least(wanted, F.ceil(F.col("_n") / LEAST)))
    sized = kept.join(sizes.crossJoin(F.broadcast(count)).select(*pools, blocks.cast("int").alias("_blocks")), pools)  # one row
    mine = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.when(other == mine, F.array(F.struct(mine.alias("l"), mine.alias("r"), F.lit(BOTH).alias("side")))).otherwise(F.array(F.struct(mine.alias("l"), other.alias("r"), F.lit(LEFT).alias("side")), F.struct(other.alias("l"), mine.alias("r"), F.lit(RIGHT).alias("side")))))
    dealt = sized.withColumn("_cell", F.explode(F.flatten(cells))).select(*pools, F.col("_cell.l").alias("_l"), F.col("_cell.r").alias("_r"), F.col("_cell.side").alias("_side"), key, *others)
    kinds = ", ".join(f"`{p}` {rows.schema[p].dataType.simpleString()}" for p in pools)

    def cell(table: pa.Table) -> pa.Table:
        side = table.column("_side")
        found = work(table.filter(pc.not_equal(side, RIGHT)), table.filter(pc.not_equal(side, LEFT)))
        n = len(next(iter(found.values())))
        return pa.table({**{p: pa.repeat(table.column(p)[0], n) for p in pools}, **found})

    # a fixed number of tasks: cells are long work on few bytes, by which adaptive execution would put them all into one
    tasks = max(CELLS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = (dealt.where("_l <= _r") if once else dealt).repartition(tasks, *pools, "_l", "_r")
    return spread.groupBy(*pools, "_l", "_r").applyInArrow(cell, f"{kinds}, {schema}")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row of doubles for each list; rows that are null, shorter than others or hold a null are filled with NaN."""
    found = pa.chunked_array(column, type=column.type).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(found).to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(sizes), sizes.max(initial=0)), np.nan)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _pair(a: pa.Table, b: pa.Table, vector: str) -> tuple[np.ndarray, np.ndarray]:
    x, y = _matrix(a.column(vector)), _matrix(b.column(vector))
    wider = max(x.shape[1], y.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wider - m.shape[1])), constant_values=np.nan) for m in (x, y))


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[:-1])
    for i in range(x.shape[-1]):
        total += x[..., i] * x[..., i]
    return np.sqrt(total)


def distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of ``similarity.METRICS`` between all rows of both matrices; cosine only of rows that aren't zero."""
    return _measured(metric, x[:, None, :], y[None, :, :])


def _each(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of ``x`` to the row of ``y`` in its place."""
    return _measured(metric, x, y)


def _measured(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dims = x.shape[-1]
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for i in range(dims):
        if metric == "cosine":
            total += x[..., i] * y[..., i]
        else:
            gap = x[..., i] - y[..., i]
            total += np.abs(gap) if metric == "manhattan" else gap * gap
    if metric == "cosine":
        return 1.0 - total / (_norms(x) * _norms(y))
    return total / dims if metric == "manhattan" else np.sqrt(total / dims)


def _within(metric: str, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which pairs can be within each row's limit: all that are, and some that exceed it by rounding errors; for cosine both are on the unit sphere.

    One product of single precision compares half the squared distance with the limit; what it can be off by is in proportion to the squares about
    the middle of ``x`` and on the side of keeping a pair.
    """
    if metric == "manhattan":
        return _measured(metric, x[:, None, :], y[None, :, :]) <= limit[:, None]
    squared = 2 * limit if metric == "cosine" else limit * limit * x.shape[1]
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    kind = np.float32 if max(xx.max(initial=0), yy.max(initial=0), squared.max(initial=0)) < 1e30 else float
    left = np.c_[x, np.ones(len(x)), squared * (0.5 + SPARE) - xx * (0.5 - SPARE)].astype(kind)
    right = np.c_[y, yy * (SPARE - 0.5), np.ones(len(y))].astype(kind)
    return ~(left @ right.T < 0)


def _found(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true; eight are looked at together where their number allows."""
    flat = np.ascontiguousarray(mask).ravel()
    if len(flat) % 8:
        return np.divmod(np.flatnonzero(flat), mask.shape[1])
    eights = np.flatnonzero(flat.view(np.uint64))
    which, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[which] * 8 + place, mask.shape[1])


def _leaves(x: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Positions of the rows, cut at medians of the widest dimension until a part is small."""
    done, open_ = [], [np.arange(len(x))] if len(x) else []
    while open_:
        at = open_.pop()
        if len(at) <= size:
            done.append(at)
            continue
        part = x[at]
        cut = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], len(at) // 2)
        open_ += [at[cut[: len(at) // 2]], at[cut[len(at) // 2 :]]]
    return done


def _bounds(metric: str, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance that each row can have to a row inside each box; for cosine both are on the unit sphere."""
    total = np.zeros((len(q), len(low)))
    for i in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, i] - q[:, i, None], q[:, i, None] - high[None, :, i]), 0)
        total += gap if metric == "manhattan" else gap * gap
    if metric == "cosine":
        return total / 2
    return total / q.shape[1] if metric == "manhattan" else np.sqrt(total / q.shape[1])


def _digits(d: np.ndarray) -> np.ndarray:
    return np.floor(d * 1e9 + 0.5) / 1e9


def _least(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (value, id) of each row."""
    order = np.lexsort((ids, values, rows))
    first = np.r_[True, rows[order][1:] != rows[order][:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _nearest_in_cell(key: str, vector: str, k: int, metric: str, listed: bool = False) -> Callable:
    def work(a: pa.Table, b: pa.Table) -> dict[str, pa.Array]:
        x, y = _pair(a, b, vector)
        _, codes = np.unique(np.r_[a.column(key).to_numpy(), b.column(key).to_numpy()], return_inverse=True)
        left, right = codes[: len(x)], codes[len(x) :]
        # rows at one distance from all others: null, or 1 for the cosine
        odd = (lambda m: ~(_norms(m) > 0)) if metric == "cosine" else (lambda m: np.isnan(m).any(axis=1))
        apart = 1.0 if metric == "cosine" else np.nan
        odd_x, odd_y = odd(x), odd(y)

        def first_ids(at: np.ndarray) -> np.ndarray:
            return at[np.unique(right[at], return_inverse=True)[1] <= k] if len(at) else at

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
            other = left[rows] != right[cols]
            rows, cols, values = rows[other], cols[other], values[other]
            best = _least(rows, cols, np.where(np.isnan(values), np.inf, _digits(values)), right[cols], k)
            found.append((rows[best], cols[best], values[best]))

        every, few = first_ids(np.arange(len(y))), first_ids(np.flatnonzero(odd_y))
        strange = np.flatnonzero(odd_x)
        keep(np.repeat(strange, len(every)), np.tile(every, len(strange)), np.full(len(strange) * len(every), apart))
        plain_x, plain_y = np.flatnonzero(~odd_x), np.flatnonzero(~odd_y)
        on = (lambda m: m / _norms(m)[:, None]) if metric == "cosine" else (lambda m: m)
        px, py = on(x[plain_x]), on(y[plain_y])
        leaves = _leaves(py)
        if leaves:  # rows of a leaf stand together
            order = np.concatenate(leaves)
            plain_y, py = plain_y[order], py[order]
        sizes = np.array([len(at) for at in leaves], int)
        start = np.r_[0, np.cumsum(sizes)]
        low, high = (np.array([f(py[i:j]) for i, j in zip(start[:-1], start[1:], strict=True)]).reshape(len(leaves), x.shape[1]) for f in (lambda m: m.min(axis=0), lambda m: m.max(axis=0)))
        for own in _leaves(px, ASKED):
            rows, q, p = plain_x[own], x[plain_x[own]], px[own]
            r, c, v = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
            if leaves:
                least, most = p.min(axis=0), p.max(axis=0)
                near = np.argsort(((low + high - least - most) ** 2).sum(axis=1), kind="stable")
                some = np.zeros(len(leaves), bool)
                some[near[: 1 + np.searchsorted(np.cumsum(sizes[near]), max(SEEN, k + 1))]] = True
                first = plain_y[np.repeat(some, sizes)]
                d = distances(metric, q, y[first])
                d[left[rows][:, None] == right[first][None, :]] = np.inf
                limit = (np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(own), np.inf)) + SLACK
                at = _found((d <= limit[:, None]) & np.isfinite(d))
                r, c, v = [rows[at[0]]], [first[at[1]]], [d[at]]
                gap = np.maximum(np.maximum(low - most, least - high), 0)
                places = np.flatnonzero(np.repeat(~some & (_bounds(metric, np.zeros((1, gap.shape[1])), gap, gap)[0] <= limit.max()), sizes))
                for i in range(0, len(places), MET):
                    part = places[i : i + MET]
                    at = _found(_within(metric, p, py[part], limit))
                    r.append(rows[at[0]])
                    c.append(plain_y[part[at[1]]])
                    v.append(_each(metric, q[at[0]], y[c[-1]]))
            keep(np.concatenate([*r, np.repeat(rows, len(few))]), np.concatenate([*c, np.tile(few, len(rows))]), np.concatenate([*v, np.full(len(rows) * len(few), apart)]))
        r, c, v = (np.concatenate([f[i] for f in found]) for i in range(3))
        if listed:  # what is kept of a row stands together and in order
            at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
            each = pa.StructArray.from_arrays([pa.array(_digits(v)), b.column(key).take(pa.array(c, pa.int64())).combine_chunks()], ["digits", "right_id"])
            return {"left_id": a.column(key).take(pa.array(r[at], pa.int64())), "near": pa.ListArray.from_arrays(pa.array(np.r_[at, len(r)].astype(np.int32)), each)}
        return {"left_id": a.column(key).take(pa.array(r, pa.int64())), "right_id": b.column(key).take(pa.array(c, pa.int64())), "distance": pa.array(v, pa.float64(), from_pandas=True)}

    return work


def nearest(rows: DataFrame, key: str, pools: list[str], vector: str, k: int, metric: str = "rms", block: int = NEAR) -> DataFrame:
    """(pools, left_id, right_id, distance, rank): the k nearest of each row in its pool, by distance to nine digits and id; null distances are last."""
    kind = rows.schema[key].dataType.simpleString()
    found = in_cells(rows, key, pools, [vector], _nearest_in_cell(key, vector, k, metric), f"left_id {kind}, right_id {kind}, distance double", block)
    order = Window.partitionBy(*pools, "left_id").orderBy(F.round("distance", 9).asc_nulls_last(), "right_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_lists(rows: DataFrame, key: str, pools: list[str], vector: str, k: int, metric: str = "rms", block: int = NEAR) -> DataFrame:
    """(pools, left_id, near): the same ids as ``nearest`` as a list in order of rank; rows of one ``left_id`` share a partition."""
    kind = rows.schema[key].dataType.simpleString()
    found = in_cells(rows, key, pools, [vector], _nearest_in_cell(key, vector, k, metric, True), f"left_id {kind}, near array<struct<digits:double,right_id:{kind}>>", block)
    merged = found.repartition("left_id").groupBy(*pools, "left_id").agg(F.collect_list("near").alias("_lists"))
    near = F.when(F.size("_lists") == 1, F.get("_lists", F.lit(0))).otherwise(F.slice(F.array_sort(F.flatten("_lists")), 1, k))
    return merged.select(*pools, "left_id", near["right_id"].alias("near"))


# Sums and counts of distances --------------------------------------------------------------------------------------------

STRIP = 512
"""Rows of the left block that meet the right one at a time."""
FINE = 40
"""Bits of a distance that a first count leaves out: 4,096 counts from one power of two to the next."""


def _sums_in_cell(key: str, vector: str, label: str) -> Callable:
    def work(a: pa.Table, b: pa.Table) -> dict[str, pa.Array]:
        x, y = _pair(a, b, vector)
        labels, at = np.unique(b.column(label).to_numpy(), return_inverse=True)
        one = (at[:, None] == np.arange(len(labels))).astype(float)
        total = np.zeros((len(x), len(labels)))
        for i in range(0, len(x), STRIP):
            d = np.zeros((len(x[i : i + STRIP]), len(y)))
            for j in range(x.shape[1]):
                gap = x[i : i + STRIP, j, None] - y[None, :, j]
                gap *= gap
                d += gap
            total[i : i + STRIP] = np.sqrt(d, out=d) @ one
        rows = pa.array(np.repeat(np.arange(len(x)), len(labels)))
        return {
            "left_id": a.column(key).take(rows), "own": a.column(label).take(rows), "other": pa.array(np.tile(labels, len(x)), a.schema.field(label).type),
            "total": pa.array(total.ravel(), from_pandas=True), "n": pa.array(np.tile(one.sum(axis=0).astype(np.int64), len(x))),
        }

    return work


def label_sums(rows: DataFrame, key: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """(left_id, own, other, total, n): for each row and label the sum of its Euclidean distances to the rows of that label, itself included."""
    kind, named = (rows.schema[c].dataType.simpleString() for c in (key, label))
    cells = in_cells(rows.where(F.col(label).isNotNull()).withColumn("_all", F.lit(0)), key, ["_all"], [vector, label], _sums_in_cell(key, vector, label), f"left_id {kind}, own {named}, other {named}, total double, n long", block)
    return cells.groupBy("left_id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _counts_in_cell(key: str, vector: str, metric: str, cut: bool) -> Callable:
    """Counts of the positive distances of each pair, met once: by their leading bits, or by value inside the range of leading bits that a row carries."""

    def work(a: pa.Table, b: pa.Table) -> dict[str, pa.Array]:
        x, y = _pair(a, b, vector)
        _, codes = np.unique(np.r_[a.column(key).to_numpy(), b.column(key).to_numpy()], return_inverse=True)
        left, right = codes[: len(x)], codes[len(x) :]
        inside = a.num_rows and b.num_rows and a.column("_l")[0] == a.column("_r")[0]
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low, high = (a.column(c)[0].as_py() << FINE for c in ("_low", "_high")) if cut and a.num_rows else (0, 0)
        for i in range(0, len(x), STRIP):
            d = distances(metric, x[i : i + STRIP], y)
            d = d[(d > 0) & (left[i : i + STRIP, None] < right[None, :] if inside else left[i : i + STRIP, None] != right[None, :])]
            bits = d.view(np.int64)
            if cut:
                value, n = np.unique(bits[(bits >= low) & (bits < high + (1 << FINE))], return_counts=True)
            else:
                bits = bits >> FINE
                least = bits.min(initial=0 if not len(bits) else bits[0])
                n = np.bincount(bits - least)
                value, n = np.flatnonzero(n) + least, n[n > 0]
            values.append(value)
            counts.append(n)
        value, place = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts), minlength=len(value)).astype(np.int64)
        return {"value": pa.array(value.view(np.float64) if cut else value), "n": pa.array(n, pa.int64())}

    return work


def distance_medians(rows: DataFrame, key: str, group: str, vector: str, metric: str = "rms", block: int = BLOCK) -> DataFrame:
    """(grp, pairs, d50): the exact median of the positive distances of a group's pairs.

    Distances are counted by their leading bits first; those that share them with the middle are counted one by one in a second pass.
    """
    known = stored(rows.select(F.col(group).alias("grp"), F.col(key).alias("id"), F.col(vector).alias("v")), "median-rows")
    counted = lambda d, others, kind, cut: in_cells(d, "id", ["grp"], others, _counts_in_cell("id", "v", metric, cut), f"value {kind}, n long", block, once=True).groupBy("grp", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("grp")
    upto = F.sum("n").over(by.orderBy("value")).alias("upto")  # leading bits of a group: some ten thousand at most
    first, last = F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2)
    rough = counted(known, ["v"], "long", False).select("grp", "value", "n", upto, F.sum("n").over(by).alias("pairs"))
    holds = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    cuts = rough.where(holds(first) | holds(last)).groupBy("grp", "pairs").agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.min(F.col("upto") - F.col("n")).alias("_before"))
    cuts = stored(cuts, "median-cuts")
    near = counted(known.join(F.broadcast(cuts), "grp"), ["v", "_low", "_high"], "double", True)  # a row per group
    placed = near.select("grp", "value", "n", upto).join(F.broadcast(cuts), "grp").withColumn("upto", F.col("upto") + F.col("_before"))  # a row per group
    middle = placed.where(holds(first) | holds(last)).groupBy("grp", "pairs")
    return middle.agg(((F.max(F.when(holds(first), F.col("value"))) + F.max(F.when(holds(last), F.col("value")))) / 2).alias("d50"))
