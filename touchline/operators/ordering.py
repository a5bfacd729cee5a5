"""Positions and running sums over a total order of all rows, without one task that sees them all.

Rows are dealt to ranges of the order and stored with their range; totals of the ranges, one row each, are summed up and added to
the running sums inside each range. Values with ties are counted first, so that equal values never straddle a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.scratch import stored


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, str | Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of its expression over all rows up to and including this one. ``order`` must be total."""
    valued = rows.withColumns({f"_{name}": F.col(c) if isinstance(c, str) else c for name, c in sums.items()})
    ranged = stored(valued.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{n}").alias(n) for n in sums]).select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(F.broadcast(totals), "_range").withColumns({n: F.sum(f"_{n}").over(inside) + F.col(f"_before_{n}") for n in sums})
    return found.drop("_range", *[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def ordinals(rows: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``rows`` with their position in the order, from 0."""
    return running_sums(rows, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, rank) of each distinct value that isn't null; ties share their mean rank, from 1."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    return running_sums(counts, [value], {"_upto": "_n"}).select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson's r of the average ranks, over rows in which both are present; null if a side is constant."""
    pairs = stored(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")), "rank-pairs")
    weighted = lambda side: average_rank_of(pairs, side).withColumnRenamed("rank", f"r{side}")
    j = pairs.join(weighted("x"), "x").join(weighted("y"), "y")
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    m = j.agg(F.sum(n).alias("n"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"), F.sum(n * rx * ry).alias("xy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt(n * F.col("xx") - sx * sx) * F.sqrt(n * F.col("yy") - sy * sy)
    return m.select(F.try_divide(n * F.col("xy") - sx * sy, spread).alias("spearman"))


def average_rank_of(pairs: DataFrame, side: str) -> DataFrame:
    """Average ranks where a row stands for ``n`` rows."""
    counts = pairs.groupBy(side).agg(F.sum("n").alias("_n"))
    return running_sums(counts, [side], {"_upto": "_n"}).select(side, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share the smallest value that at least so much of the rows doesn't exceed; null without rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    placed = stored(running_sums(counts, ["v"], {"upto": "n"}), "placed-values")
    whole = placed.agg(F.max("upto").alias("size"))
    return placed.crossJoin(F.broadcast(whole)).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("size") - 1e-9), F.col("v"))).alias(name) for name, p in shares.items()])  # one row


def group_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median) of the values that aren't null: the middle one, or the mean of both, found by running counts, so that no task holds a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = stored(running_sums(counts, [group, "_v"], {"_upto": "_n"}), "placed-groups")
    whole = placed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("n"))
    inside = placed.join(whole, group).withColumns({"_first": F.col("_upto") - F.col("_n") - F.col("_before"), "_last": F.col("_upto") - F.col("_before")})
    holds = lambda at: (F.col("_first") <= at) & (at < F.col("_last"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = inside.where(holds(low) | holds(high))  # two rows of a group at most
    return middle.groupBy(group, "n").agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median"))
