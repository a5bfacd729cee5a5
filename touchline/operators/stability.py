"""Stability of neighbours over halves and resamples, the choice of a method, support, and neighbours with a fall-back pool.

The resample is part of every key, so all of them are one job. Pairs are formed in cells of two blocks of a pool; only the k best
of a row leave a task before they are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import cells
from touchline.operators.similarity import METRICS, blocked_pairs  # noqa: F401
from touchline.sources.scratch import stored

TOP = (5, 6, 10)
KEPT = 11
"""One more than the longest list, so that a list isn't taken for the whole pool."""


def ranked(pairs: DataFrame, pools: list[str], k: int) -> DataFrame:
    """The k nearest of each row in its pool, by distance to nine digits and id; ``pairs`` has ``distance``."""
    order = Window.partitionBy(*pools, "left_id").orderBy(F.round("distance", 9).asc_nulls_last(), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, key: str, pools: list[str], k: int = KEPT, metric: str = "rms", block: int = cells.NEAR) -> DataFrame:
    """(pools, left_id, right_id, distance, rank); ``rows`` has ``v``."""
    return cells.nearest(rows, key, pools, "v", k, metric, block)


def compared(reference: DataFrame, other: DataFrame, runs: list[str]) -> DataFrame:
    """(runs, left_id, candidates, top_k_overlap, top_k_jaccard, rank_spearman) for each row that both rankings have.

    ``reference`` and ``other`` have left_id, right_id, rank; ``other`` also ``runs``, which ``reference`` may have too. A list that takes
    in the whole pool says nothing: its numbers are null. Ranks are compared where three candidates or more are common.
    """
    shared = [c for c in runs if c in reference.columns]
    sizes = lambda d, by, n: d.groupBy(*by, "left_id").agg(F.count("*").alias(n))
    both = sizes(reference, shared, "_n").join(sizes(other, runs, "_m"), [*shared, "left_id"]).withColumn("candidates", F.least("_n", "_m")).select(*runs, "left_id", "candidates")
    common = reference.select(*shared, "left_id", "right_id", F.col("rank").alias("x")).join(other.select(*runs, "left_id", "right_id", F.col("rank").alias("y")), [*shared, "left_id", "right_id"])
    w = Window.partitionBy(*runs, "left_id")
    again = common.withColumns({"rx": F.row_number().over(w.orderBy("x")), "ry": F.row_number().over(w.orderBy("y"))})
    met = again.groupBy(*runs, "left_id").agg(F.count("*").alias("c"), F.sum((F.col("rx") - F.col("ry")) * (F.col("rx") - F.col("ry"))).alias("d"), *[F.count(F.when((F.col("x") <= k) & (F.col("y") <= k), 1)).alias(f"_{k}") for k in TOP])
    joined = both.join(met, [*runs, "left_id"], "left")
    n = F.col("c").cast("double")
    columns: list[Column] = []
    for k in TOP:
        of = F.when(F.col("candidates") > k, F.coalesce(F.col(f"_{k}"), F.lit(0)).cast("double"))
        columns += [(of / k).alias(f"top_{k}_overlap"), (of / (2 * k - of)).alias(f"top_{k}_jaccard")]
    return joined.select(*runs, "left_id", "candidates", *columns, F.when(F.col("c") >= 3, 1 - 6 * F.col("d") / (n * (n * n - 1))).alias("rank_spearman"))


def compared_lists(reference: DataFrame, other: DataFrame, kept: list[str]) -> DataFrame:
    """(kept, left_id, candidates, measures) as ``compared``, of ``cells.nearest_lists``: no row per pair, and no shuffle of ``other`` beyond that by left_id."""
    both = other.join(reference.select("left_id", F.col("near").alias("_x"), *[c for c in kept if c not in other.columns]).hint("shuffle_hash"), "left_id")
    both = both.withColumns({"candidates": F.least(F.size("_x"), F.size("near")), "_c": F.array_intersect("_x", "near"), "_o": F.array_intersect("near", "_x")})
    apart = F.transform("_c", lambda item, i: i + 1 - F.array_position("_o", item))
    met = both.withColumns({"_n": F.size("_c").cast("double"), "_d": F.aggregate(apart, F.lit(0).cast("bigint"), lambda s, x: s + x * x)})
    n, columns = F.col("_n"), []
    for k in TOP:
        of = F.when(F.col("candidates") > k, F.size(F.array_intersect(F.slice("_x", 1, k), F.slice("near", 1, k))).cast("double"))
        columns += [(of / k).alias(f"top_{k}_overlap"), (of / (2 * k - of)).alias(f"top_{k}_jaccard")]
    return met.select(*kept, "left_id", "candidates", *columns, F.when(n >= 3, 1 - 6 * F.col("_d") / (n * (n * n - 1))).alias("rank_spearman"))


MEASURES = [f"top_{k}_{m}" for k in TOP for m in ("overlap", "jaccard")] + ["rank_spearman"]


def player_means(each: DataFrame, run: str, keys: list[str] = ()) -> DataFrame:
    """(keys, left_id, runs, means of all measures); ``each`` has a row per run and left_id."""
    return each.groupBy(*keys, "left_id").agg(F.count(run).alias("runs"), *[F.avg(m).alias(m) for m in MEASURES])


def summarised(means: DataFrame, group: str, keys: list[str] = ()) -> DataFrame:
    """(keys, group, measure, n, mean, median, p10, p25) by group and, as ``ALL``, over all rows; a row per player goes in."""
    long = means.unpivot([*keys, group], MEASURES, "measure", "x").where("x is not null")
    each = long.withColumn(group, F.explode(F.array(F.col(group), F.lit("ALL"))))
    return each.groupBy(*keys, group, "measure").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *[F.percentile("x", p).alias(name) for name, p in (("median", 0.5), ("p10", 0.1), ("p25", 0.25))])


# The choice --------------------------------------------------------------------------------------------------------------

TOLERANCE = 0.01
PRIORITY = ["rms", "manhattan", "cosine"]
FLOOR = {"split_mean": 0.35, "split_median": 1 / 3, "split_spearman": 0.25, "resample_mean": 0.6}


def chosen_method(results: DataFrame) -> DataFrame:
    """One row: of the methods within 0.01 of the best score the one with fewest features, simplest distance, best score, first name.

    ``results``: feature_set, feature_count, method, split_mean, split_median, split_spearman, resample_mean, a row per method; the score
    is the mean of split_mean and resample_mean, and methods without both can't be chosen. ``defensible``: all floors are reached.
    """
    scored = results.where(F.col("split_mean").isNotNull() & F.col("resample_mean").isNotNull()).withColumn("score", (F.col("split_mean") + F.col("resample_mean")) / 2)
    best = scored.agg(F.max("score").alias("best_score"))
    near = scored.crossJoin(best).where(F.col("best_score") - F.col("score") <= TOLERANCE + 1e-12)  # one row
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("method"))
    first = near.orderBy("feature_count", F.when(place > 0, place).otherwise(len(PRIORITY) + 1), F.desc("score"), "feature_set").limit(1)
    reached = [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in FLOOR.items()]
    ok = reached[0]
    for r in reached[1:]:
        ok = ok & r
    return first.withColumn("defensible", ok)


def by_support(players: DataFrame, means: DataFrame, key: str, support: str, thresholds: list[int], least: int = 20) -> DataFrame:
    """(threshold, kind, players, mean_support, measurable, mean_overlap, median_overlap, meaningful) for players with at least so much support.

    ``means``: kind, left_id, top_6_overlap; a kind without measurable players at a threshold has nulls.
    """
    kinds = means.select("kind").distinct()
    wanted = players.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    kept = players.join(F.broadcast(wanted), F.col(support) >= F.col("threshold"))  # the thresholds
    counts = kept.groupBy("threshold").agg(F.count("*").alias("players"), F.avg(support).alias("mean_support"))
    found = kept.join(means.where("top_6_overlap is not null"), kept[key] == means["left_id"]).groupBy("threshold", "kind").agg(F.count("*").alias("measurable"), F.avg("top_6_overlap").alias("mean_overlap"), F.percentile("top_6_overlap", 0.5).alias("median_overlap"))
    every = wanted.crossJoin(F.broadcast(kinds)).join(counts, "threshold", "left").join(found, ["threshold", "kind"], "left")  # thresholds and kinds
    players_, measurable = F.coalesce("players", F.lit(0)), F.coalesce("measurable", F.lit(0))
    return every.select("threshold", "kind", players_.alias("players"), "mean_support", measurable.alias("measurable"), "mean_overlap", "median_overlap", (players_ >= least).alias("meaningful"))


# Fall-back ---------------------------------------------------------------------------------------------------------------

# Outfield groups beside one another.
ADJACENT = {"DEF": ["MID"], "MID": ["DEF", "FWD"], "FWD": ["MID"], "GK": []}


def neighbours_with_fallback(rows: DataFrame, key: str, cohort: str, group: str, k: int = 10, least: int = 5, metric: str = "rms") -> DataFrame:
    """(cohort, left_id, right_id, right_group, fell_back, distance, rank): neighbours of the own group; where fewer than ``least`` are there, adjacent groups join in.

    ``rows`` has ``v``. Groups that are large enough, or have no adjacent ones, are ranked in cells; of the others each has ``least`` rows at most, and only these meet
    the rows of their groups pair by pair. Null distances are last.
    """
    known = stored(rows.select(cohort, group, key, "v"), "fallback-rows")
    sizes = known.groupBy(cohort, group).agg((F.count("*") - 1).alias("_others"))
    beside = F.create_map(*[x for g, near in ADJACENT.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in near]).cast("array<string>"))])
    adjacent = F.coalesce(F.try_element_at(beside, F.col(group)), F.array().cast("array<string>"))
    sized = known.join(sizes, [cohort, group]).withColumn("_short", (F.col("_others") < least) & (F.size(adjacent) > 0))
    columns = [cohort, "left_id", "right_id", "right_group", "fell_back", "distance"]
    own = cells.nearest(sized.where(~F.col("_short")), key, [cohort, group], "v", k, metric).withColumns({"right_group": F.col(group), "fell_back": F.lit(False)})
    asked = sized.where("_short").select(cohort, F.col(key).alias("left_id"), F.col("v").alias("a"), F.explode(F.concat(F.array(group), adjacent)).alias("right_group"))
    other = known.select(cohort, F.col(group).alias("right_group"), F.col(key).alias("right_id"), F.col("v").alias("b"))
    pairs = asked.join(other, [cohort, "right_group"]).where("left_id <> right_id").withColumns({"fell_back": F.lit(True), "distance": METRICS[metric](F.col("a"), F.col("b"))})
    return ranked(own.select(*columns).unionByName(pairs.select(*columns)), [cohort], k)
