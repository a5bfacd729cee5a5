"""Vector distance, neighbours, role fit and overlap of rankings.

Pairs are formed inside a group only, in cells of two blocks; the callers keep groups to eligible players, not events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import cells


def _folded(a: Column, b: Column, term, zero: float = 0.0, dims: int | None = None) -> Column:
    """Sum of a term over two arrays; where their length is given, as plain arithmetic, which is compiled."""
    if dims:
        total = F.lit(zero)
        for i in range(dims):
            total = total + term(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
        return total
    return F.aggregate(F.zip_with(a, b, term), F.lit(zero), lambda s, x: s + x)


def rms(a: Column, b: Column, dims: int | None = None) -> Column:
    """Root mean square difference of two arrays of doubles."""
    return F.sqrt(F.try_divide(_folded(a, b, lambda x, y: (x - y) * (x - y), dims=dims), F.size(a).cast("double")))


def manhattan(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.try_divide(_folded(a, b, lambda x, y: F.abs(x - y), dims=dims), F.size(a).cast("double"))


def cosine_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    dot, na, nb = (_folded(x, y, lambda p, q: p * q, dims=dims) for x, y in ((a, b), (a, a), (b, b)))
    return F.coalesce(F.lit(1.0) - F.try_divide(dot, F.sqrt(na) * F.sqrt(nb)), F.lit(1.0))


METRICS = {"rms": rms, "manhattan": manhattan, "cosine": cosine_distance}


def rounded(x: Column, digits: int) -> Column:
    """A number of moderate size rounded half up, in plain arithmetic: a tenth of the time of ``round``, which goes through decimals."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def blocked_pairs(rows: DataFrame, key: str, pools: list[str], block: int = 2048, unique: bool = False) -> DataFrame:
    """(pools, left_id, right_id, a, b): pairs of different rows of a pool; ``rows`` has ``v``. A cell joins one block with one block; ``unique`` keeps left < right.

    Both sides are shuffled: their copies for the cells are many more than the rows that the optimizer counts.
    """
    sizes = rows.groupBy(*pools).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, pools).withColumns({"_mine": F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    left = dealt.select(*pools, F.col(key).alias("left_id"), F.col("v").alias("a"), F.col("_mine").alias("_l"), F.col("_other").alias("_r"))
    right = dealt.select(*[F.col(p).alias(f"_{p}") for p in pools], F.col(key).alias("right_id"), F.col("v").alias("b"), F.col("_other").alias("_l2"), F.col("_mine").alias("_r2"))
    if unique:  # two blocks meet once, whichever has the smaller id
        left, right = left.where("_l <= _r"), right.where("_l2 <= _r2")
    apart = F.col("left_id") != F.col("right_id")
    if unique:
        apart = apart & ((F.col("_l") < F.col("_r")) | (F.col("left_id") < F.col("right_id")))
    on = (F.col("_l") == F.col("_l2")) & (F.col("_r") == F.col("_r2")) & apart
    for p in pools:
        on = on & (F.col(p) == F.col(f"_{p}"))
    found = left.join(right.hint("merge"), on)
    if not unique:
        return found.select(*pools, "left_id", "right_id", "a", "b")
    first = F.col("left_id") < F.col("right_id")
    ordered = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("left_id", "right_id"), ("right_id", "left_id"), ("a", "b"), ("b", "a"))]
    return found.select(*pools, *ordered)


def pairs(rows: DataFrame, key: str, group: str, vector: str, metric: str = "rms", unique: bool = False, dims: int | None = None) -> DataFrame:
    """All pairs of a group with their distance; ``unique`` keeps left < right. ``dims``: the length of all vectors, if known."""
    found = blocked_pairs(rows.select(F.col(group).alias("grp"), key, F.col(vector).alias("v")), key, ["grp"], unique=unique)
    return found.select("grp", "left_id", "right_id", METRICS[metric](F.col("a"), F.col("b"), dims).alias("distance"))


def d50(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(grp, pairs, d50): number and median of the positive distances of a group's pairs."""
    return cells.distance_medians(rows, key, group, vector)


def neighbours(rows: DataFrame, key: str, group: str, vector: str, k: int = 10, metric: str = "rms") -> DataFrame:
    """The k nearest of each row in its group, by distance to nine digits, ties to the smaller id."""
    return cells.nearest(rows.select(F.col(group).alias("grp"), key, vector), key, ["grp"], vector, k, metric)


def gaps(a: Column, b: Column, names: list[str]) -> Column:
    """(gap, place, name) of each dimension, closest first, ties in the order of the features."""
    named = F.array(*[F.lit(n) for n in names])
    listed = F.transform(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda g, i: F.struct(g.alias("gap"), i.alias("place"), F.get(named, i).alias("name")))
    return F.array_sort(listed)


def contributions(a: Column, b: Column, dims: int | None = None) -> Column:
    """Shares of the squared distance by dimension; zeros where the vectors are equal."""
    if dims:
        gaps = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(dims)]
        total = _folded(a, b, lambda x, y: (x - y) * (x - y), dims=dims)
        return F.array(*[F.coalesce(F.try_divide(g * g, total), F.lit(0.0)) for g in gaps])
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    whole = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.transform(squares, lambda x: F.coalesce(F.try_divide(x, whole), F.lit(0.0)))


def centroids(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    return rows.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])


def margins(rows: DataFrame, key: str, vector: str, centres: DataFrame, label: str, centre: str) -> DataFrame:
    """Nearest and second nearest centre of each row and the difference of their distances. ``centres`` is small by construction: a row per label."""
    near = rows.crossJoin(F.broadcast(centres.select(F.col(label).alias("_l"), F.col(centre).alias("_c")))).select(key, "_l", rms(F.col(vector), F.col("_c")).alias("_d"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("_d", "_l"))), 1, 2)
    return near.groupBy(key).agg(two.alias("t")).select(key, F.get("t", F.lit(0))["_l"].alias("nearest"), F.get("t", F.lit(0))["_d"].alias("distance"), (F.get("t", F.lit(1))["_d"] - F.get("t", F.lit(0))["_d"]).alias("margin"))


def overlap(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Size of the intersection and Jaccard index of two rankings' top rows for each key."""
    a, b = (d.groupBy(key).agg(F.collect_set(item).alias(n)) for d, n in ((left, "_x"), (right, "_y")))
    both = F.size(F.array_intersect("_x", "_y"))
    return a.join(b, key).select(key, both.alias("shared"), F.round(F.try_divide(both.cast("double"), F.size(F.array_union("_x", "_y")).cast("double")), 6).alias("jaccard"))
