"""Player metrics by family with peers, eligibility and reasons; the radar rule; team and role profiles with their support."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PEERS = 10
LEAST_RADAR = 3
HIGHER_SUPPORT = 3
"""Matches from which on support counts as higher."""
LIMITED_CONTRIBUTORS = 3


@dataclass(frozen=True)
class Metric:
    name: str
    family: str
    sample: str
    least: int
    unit: str
    radar: bool = False


def checked(registry: list[Metric]) -> list[Metric]:
    """The registry, if names are unique, both families occur and thresholds are positive."""
    names = [m.name for m in registry]
    if len(names) != len(set(names)):
        raise ValueError("metric names must be unique")
    if {m.family for m in registry} != {"style", "performance"}:
        raise ValueError("every metric is of style or performance, and both occur")
    if any(m.least < 1 for m in registry):
        raise ValueError("a minimum sample is at least 1")
    return registry


def metric_rows(profiles: DataFrame, key: str, group: str, registry: list[Metric], peers: int = LEAST_PEERS) -> DataFrame:
    """(key, group, metric, family, unit, radar, raw_value, sample_count, peer_count, percentile, eligible, reason), a row per player and metric.

    Percentiles are average ranks among the eligible of a group. The first reason that holds is given: no value, too small a sample, too few peers.
    """
    facts = [F.struct(F.lit(m.name).alias("metric"), F.lit(m.family).alias("family"), F.lit(m.unit).alias("unit"), F.lit(m.radar).alias("radar"), F.lit(m.least).alias("least"), F.lit(m.sample).alias("sample"), F.col(m.name).cast("double").alias("raw_value"), F.coalesce(F.col(m.sample), F.lit(0)).cast("long").alias("sample_count")) for m in checked(registry)]
    long = profiles.select(key, group, F.explode(F.array(*facts)).alias("m")).select(key, group, "m.*")
    measured = F.col("raw_value").isNotNull() & ~F.isnan("raw_value") & (F.col("sample_count") >= F.col("least"))
    cell, tied = Window.partitionBy("metric", group), Window.partitionBy("metric", group, "measured", "raw_value")
    counted = long.withColumn("measured", measured).withColumn("peer_count", F.count(F.when(F.col("measured"), 1)).over(cell))
    rank = F.rank().over(Window.partitionBy("metric", group, "measured").orderBy("raw_value")) + (F.count("*").over(tied) - 1) / 2
    enough = F.col("peer_count") >= peers
    reason = (
        F.when(F.col("raw_value").isNull() | F.isnan("raw_value"), "metric_unavailable")
        .when(~F.col("measured"), F.format_string("requires_%d_%s", F.col("least"), F.col("sample")))
        .when(~enough, f"requires_{peers}_eligible_position_peers")
        .otherwise("eligible")
    )
    percentile = F.when(F.col("measured") & enough, 100.0 * (rank - 1) / (F.col("peer_count") - 1))
    return counted.select(key, group, "metric", "family", "unit", "radar", "raw_value", "sample_count", "peer_count", percentile.alias("percentile"), (F.col("measured") & enough).alias("eligible"), reason.alias("reason"))


def radars(rows: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, style_metrics, performance_metrics, radar, status): a goalkeeper, and whoever has fewer than three radar metrics with a percentile, gets none."""
    on_radar = F.sort_array(F.collect_list(F.when(F.col("radar") & F.col("percentile").isNotNull(), F.col("metric"))))
    count = lambda family: F.count(F.when(F.col("family") == family, 1))
    held = rows.groupBy(key, group).agg(count("style").alias("style_metrics"), count("performance").alias("performance_metrics"), on_radar.alias("found"))
    status = F.when(F.col(group) == "GK", "limited_goalkeeper_profile").when(F.size("found") < LEAST_RADAR, "insufficient_eligible_metrics").otherwise("peer_percentiles")
    shown = F.when(status == "peer_percentiles", F.col("found")).otherwise(F.array().cast("array<string>"))
    return held.select(key, group, "style_metrics", "performance_metrics", shown.alias("radar"), status.alias("status"))


def pair_support(matches: Column) -> tuple[Column, Column]:
    """Level and message on the evidence behind two profiles; a negative count raises."""
    checked_ = F.when(matches < 0, F.raise_error(F.lit("a count of matches can't be negative")).cast("string"))
    few = matches < HIGHER_SUPPORT
    level = checked_.when(few, "limited").otherwise("higher")
    return level, F.when(few, f"Limited sample: one or both profiles use fewer than {HIGHER_SUPPORT} observed matches.").otherwise(f"Higher sample support: both profiles use at least {HIGHER_SUPPORT} observed matches.")


def player_support(matches: Column) -> tuple[Column, Column]:
    few, n = matches < HIGHER_SUPPORT, matches.cast("string")
    noun = F.when(matches == 1, "match").otherwise("matches")
    return F.when(few, "limited").otherwise("higher"), F.when(few, F.concat(F.lit("Limited sample: observed across "), n, F.lit(" "), noun, F.lit("."))).otherwise(F.concat(F.lit("Higher sample support: observed across "), n, F.lit(" matches.")))


def contributors(actions: DataFrame, keys: list[str], member: str, name: str) -> DataFrame:
    """(keys, contributor_count, top_share, contributors): the members of each group by their actions, as JSON, most first."""
    per = actions.groupBy(*keys, member, name).agg(F.count("*").alias("actions"))
    shared = per.withColumn("share", F.round(F.col("actions") / F.sum("actions").over(Window.partitionBy(*keys)), 6))
    line = F.struct((-F.col("actions")).alias("_o"), F.col(member).alias("player_id"), F.col(name).alias("player_name"), "actions", F.col("share").alias("action_share"))
    ordered = F.transform(F.sort_array(F.collect_list(line)), lambda x: F.struct(x["player_id"].alias("player_id"), x["player_name"].alias("player_name"), x["actions"].alias("actions"), x["action_share"].alias("action_share")))
    return shared.groupBy(*keys).agg(F.count("*").alias("contributor_count"), F.max("share").alias("top_share"), F.to_json(ordered).alias("contributors"))


# Shares of the first, and of the first two contributors, from which on a role counts as concentrated.
DOMINANT_ONE, DOMINANT_TWO = 0.40, 0.65


def dominance(top: Column, top_two: Column) -> Column:
    return F.when((top >= DOMINANT_ONE) | (top_two >= DOMINANT_TWO), "concentrated").otherwise("distributed")


def concentration(actions: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, players, top_share, top_two_share, hhi, note) of the members' shares of a group's actions."""
    per = actions.groupBy(*keys, member).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    shares = per.select(*keys, (F.col("n") / F.sum("n").over(w)).alias("share"), F.row_number().over(w.orderBy(F.desc("n"), member)).alias("r"))
    held = shares.groupBy(*keys).agg(F.count("*").alias("players"), F.max("share").alias("top_share"), F.sum(F.when(F.col("r") <= 2, F.col("share"))).alias("top_two_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"))
    return held.withColumn("note", dominance(F.col("top_share"), F.col("top_two_share")))


def role_support(group: Column, matches: Column, count: Column) -> tuple[Column, Column]:
    """Level and message of a role profile: few contributors make it sensitive to who they are."""
    few = count <= LIMITED_CONTRIBUTORS
    text = F.concat(F.lit("Observed across "), matches.cast("string"), F.lit(" matches and "), count.cast("string"), F.lit(" contributing "), group, F.lit(" players."))
    return F.when(few, "limited_contributor_diversity").otherwise("established"), F.when(few, F.concat(F.lit("Limited contributor diversity: "), text)).otherwise(text)


def outfield_role(group: str) -> str:
    """A role that has a profile; goalkeepers have none."""
    if group not in ("DEF", "MID", "FWD"):
        raise LookupError(f"no role profile for {group}")
    return group


def onto_statistics(profiles: DataFrame, statistics: DataFrame, group: str, features: list[str]) -> DataFrame:
    """``profiles`` with ``z_*``: each feature against stored (group, feature, mean, std); raises where a group has no statistics of a feature, or no spread."""
    wide = statistics.groupBy(group).agg(*[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"_{s}_{f}") for f in features for s in ("mean", "std")])
    joined = profiles.join(F.broadcast(wide), group, "left")  # a row per group
    broken = lambda f: F.raise_error(F.concat(F.lit(f"no usable statistics of {f} for "), F.coalesce(F.col(group), F.lit("null")))).cast("double")
    z = {f"z_{f}": F.when(F.col(f"_mean_{f}").isNotNull() & (F.col(f"_std_{f}") > 0), (F.col(f) - F.col(f"_mean_{f}")) / F.col(f"_std_{f}")).otherwise(broken(f)) for f in features}
    return joined.withColumns(z).drop(*[f"_{s}_{f}" for f in features for s in ("mean", "std")])


def standardised(rows: DataFrame, group: str, features: list[str], mean: float = 2e-6, spread: float = 1e-3) -> DataFrame:
    """``rows``, if every group's features have mean 0 and deviation 1 (a group of one: 0); raises with the first that hasn't."""
    each = rows.groupBy(group).agg(F.count("*").alias("n"), *[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.count(F.when(F.col(f).isNull() | F.isnan(f), 1)).alias(f"x_{f}"))]).collect()  # a row per group
    for row in sorted(each, key=lambda r: str(r[group])):
        for f in features:
            if row[f"x_{f}"]:
                raise ValueError(f"{f} of {row[group]}: {row[f'x_{f}']} values missing")
            if abs(row[f"m_{f}"]) > mean or abs(row[f"s_{f}"] - (row.n > 1)) > spread:
                raise ValueError(f"{f} of {row[group]} isn't standardised: mean {row[f'm_{f}']:.6g}, deviation {row[f's_{f}']:.6g}")
    return rows
