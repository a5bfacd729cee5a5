"""Aggregations: player profiles, styles, distributions, shares and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import constants as K


def rate(a: Column, b: Column) -> Column:
    """a / b, null for an empty denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")


def subset_metrics(name: str, mask: Column) -> list[Column]:
    """Attempts, completions, actual and expected rate and points above expected (percent) of the rows in ``mask``."""
    n = total(mask)
    done = F.coalesce(F.sum(F.when(mask, F.col("completed"))), F.lit(0)).cast("bigint")
    expected = F.sum(F.when(mask, F.col("expected_completion")))
    return [
        n.alias(f"{name}_attempts"),
        done.alias(f"{name}_completed"),
        F.round(rate(done, n), 6).alias(f"{name}_rate"),
        F.round(rate(expected, n), 6).alias(f"{name}_expected_rate"),
        F.round(F.lit(100.0) * rate(done.cast("double") - expected, n), 6).alias(f"{name}_above_expected_pp"),
        (n >= K.RELIABLE_SUBSET).alias(f"{name}_reliable"),
    ]


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the alphabetically first (null counts as an empty text)."""
    counts = rows.groupBy(key, F.coalesce(F.col(value), F.lit("")).alias(value)).agg(F.count("*").alias("n"))
    # the best of each key as one aggregate: most rows, then the first text
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")
    return counts.groupBy(key).agg(best).select(key, F.col("m.v").alias(f"dominant_{value}"), (-F.col("m.n")).alias("rows"))


def passing_profile(passes: DataFrame, key: str = "player_id") -> DataFrame:
    yes = F.lit(True)
    return passes.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.countDistinct("match_id").alias("matches"),
        *subset_metrics("all", yes),
        *subset_metrics("pressure", F.col("under_pressure")),
        *subset_metrics("progressive", F.col("progressive")),
        *subset_metrics("long", F.col("pass_length") >= K.LONG_PASS),
        F.round(rate(total(F.col("final_third_entry")), F.count("*")), 6).alias("final_third_rate"),
    )


def shooting_profile(shots: DataFrame, key: str = "player_id") -> DataFrame:
    n, goals, xg = F.count("*"), total(F.col("goal")), F.sum("expected_goal")
    return shots.groupBy(key).agg(
        n.alias("shots"), goals.alias("goals"), F.countDistinct("match_id").alias("matches"), F.round(xg, 6).alias("total_xg"),
        F.round(rate(xg, n), 6).alias("xg_per_shot"), F.round(goals - xg, 6).alias("goals_minus_xg"), (n >= K.RELIABLE_SHOTS).alias("reliable"),
    )


def attacking_profile(actions: DataFrame, key: str = "player_id") -> DataFrame:
    """Values per 100 actions for all actions and subsets, and the data's own reliability threshold: the rounded-up median of counts."""
    value = F.col("attacking_value")
    masks = {"all": F.lit(True), "pass": F.col("action_type") == "Pass", "carry": F.col("action_type") == "Carry", "progressive": F.col("progressive"), "pressure": F.col("under_pressure")}
    columns = []
    for name, mask in masks.items():
        columns += [total(mask).alias(f"{name}_actions"), F.round(F.lit(100.0) * rate(F.sum(F.when(mask, value)), total(mask)), 6).alias(f"{name}_per_100")]
    per = actions.where(F.col(key).isNotNull()).groupBy(key).agg(*columns, F.round(rate(total(value > 0), F.count("*")), 6).alias("positive_rate"))
    threshold = per.agg(F.greatest(F.lit(1), F.ceil(F.median("all_actions"))).cast("bigint").alias("threshold"))
    return per.crossJoin(F.broadcast(threshold)).withColumn("reliable", F.col("all_actions") >= F.col("threshold"))  # one row


def action_tendencies(actions: DataFrame, key: str = "player_id") -> DataFrame:
    n, carries = F.count("*"), total(F.col("action_type") == "Carry")
    return actions.groupBy(key).agg(
        n.alias("actions"), carries.alias("carries"), F.round(rate(carries, n), 6).alias("carry_share"),
        F.round(rate(total(F.col("progressive")), n), 6).alias("progressive_share"), F.round(rate(total(F.col("under_pressure")), n), 6).alias("pressure_share"),
    )


def style_profile(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Style rates over any grouping: of passes and carries in one pass over the rows."""
    is_pass = F.col("action_type") == "Pass"
    passes = total(is_pass)
    forward = F.sum(F.when(is_pass & (F.col("forward_distance") > 0), F.col("forward_distance")).otherwise(0.0))
    return actions.groupBy(*keys).agg(
        F.count("*").alias("actions"),
        passes.alias("passes"),
        total(~is_pass).alias("carries"),
        F.countDistinct("match_id").alias("matches"),
        F.round(rate(F.sum(F.when(is_pass, F.col("expected_completion"))), passes), 6).alias("expected_completion_rate"),
        F.round(rate(total(is_pass & F.col("under_pressure")), passes), 6).alias("pressure_pass_rate"),
        F.round(rate(total(is_pass & F.col("progressive")), passes), 6).alias("progressive_pass_rate"),
        F.round(rate(total(is_pass & (F.col("pass_length") >= K.LONG_PASS)), passes), 6).alias("long_pass_rate"),
        F.round(F.lit(100.0) * rate(forward, passes), 6).alias("forward_per_100_passes"),
        F.round(rate(total(~is_pass), F.count("*")), 6).alias("carry_share"),
    )


STYLE = ["expected_completion_rate", "pressure_pass_rate", "progressive_pass_rate", "long_pass_rate", "forward_per_100_passes", "carry_share"]


def contributions(actions: DataFrame, group: list[str], member: str) -> DataFrame:
    """Per group: members, the largest and two largest shares of actions, and the Herfindahl index of shares."""
    counts = actions.groupBy(*group, member).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), member)))
    return shares.groupBy(*group).agg(
        F.count("*").alias("members"), F.round(F.max("share"), 6).alias("top_share"), F.round(F.sum(F.when(F.col("r") <= 2, F.col("share"))), 6).alias("top_two_share"),
        F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"),
    )


def distribution(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes and interpolated percentiles."""
    v = F.col(value)
    columns = [F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")]
    columns += [F.round(F.percentile(v, p), 6).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return rows.groupBy(*(keys or [])).agg(*columns)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts with shares; a missing value is Missing. The share's window runs over the distinct values, not the rows."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def weighted_means(rows: DataFrame, keys: list[str], weight: str, features: list[str]) -> DataFrame:
    w = F.col(weight)
    return rows.groupBy(*keys).agg(*[F.round(rate(F.sum(w * F.col(f)), F.sum(F.when(F.col(f).isNotNull(), w))), 6).alias(f) for f in features])


def eta_squared(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Between over total sum of squares of each feature; 0 when there is no variation."""
    long = rows.select(group, *features).unpivot([group], features, "feature", "x").where("x is not null")
    per = long.groupBy("feature", group).agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.count("x") * F.var_pop("x")).alias("within"))
    w = Window.partitionBy("feature")
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    between = F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand")))
    return per.groupBy("feature").agg(F.round(F.coalesce(F.try_divide(between, between + F.sum("within")), F.lit(0.0)), 6).alias("eta_squared"), F.sum("n").alias("n"))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """Pearson's r of every pair of features over the rows that have both, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.round(F.col(f"c{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(listed).alias("p")).select("p.*")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumns({"ra": average_rank(a, keys), "rb": average_rank(b, keys)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def beside(base: DataFrame, keys: list[str], others: list[DataFrame], counts: list[str]) -> DataFrame:
    """``base`` with the aggregates of other sources under the same keys, missing keys included; ``counts`` are 0 where a source has no row, all else null."""
    found = base
    for n, other in enumerate(others):
        renamed = other.select(*[F.col(k).alias(f"_{n}_{k}") for k in keys], *[c for c in other.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{n}_{k}")) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        found = found.join(renamed, on, "left").drop(*[f"_{n}_{k}" for k in keys])
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
