"""Ordered operators: possessions, running scores, targets, next values, percentiles, halves.

All windows are partitioned by match, possession, group or player; none runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import constants as K

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def with_possessions(events: DataFrame, gap: str = "12 hours", match: str = "match_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``event_index`` in the match and ``possession_id``: a new possession begins after a pause longer than ``gap``."""
    w = Window.partitionBy(match).orderBy(*order)
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr(f"interval '{gap}'")).cast("int"), F.lit(1))
    return events.withColumns({"event_index": F.row_number().over(w), "_new": new}).withColumn("possession_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_state(events: DataFrame) -> DataFrame:
    """State before each event of a possession: action number, previous type, elapsed time, targets of the rest and of the next five events."""
    w = Window.partitionBy("match_id", "possession_id").orderBy("event_index")
    whole = w.rowsBetween(*ALL)
    return events.withColumns(
        {
            "action_number": F.row_number().over(w),
            "actions": F.count("*").over(Window.partitionBy("match_id", "possession_id")),
            "previous_type": F.coalesce(F.lag("event_type").over(w), F.lit("Possession Start")),
            "elapsed_s": F.greatest((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first("ts", ignorenulls=True).over(whole).cast("timestamp"))) / 1000000, F.lit(0.0)),
            "remaining_xg": F.sum("xg").over(w.rowsBetween(0, Window.unboundedFollowing)),
            "next_5_xg": F.sum("xg").over(w.rowsBetween(0, 4)),
            "next_10_xg": F.sum("xg").over(w.rowsBetween(0, 9)),
        }
    )


def with_score(events: DataFrame) -> DataFrame:
    """``score_difference`` strictly before each event, from its team's view: twice the own goals less all goals."""
    before = Window.partitionBy("match_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    team = Window.partitionBy("match_id", "team_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    own, both = F.coalesce(F.sum("is_goal").over(team), F.lit(0)), F.coalesce(F.sum("is_goal").over(before), F.lit(0))
    return events.withColumn("score_difference", 2 * own - both)


def with_next_value(states: DataFrame, value: str) -> DataFrame:
    """The next state's value inside the possession and the action's value: after - before, after 0 where the possession ends or the action fails."""
    w = Window.partitionBy("match_id", "possession_id").orderBy("event_index")
    nxt = F.lead(value).over(w)
    after = F.when(nxt.isNotNull() & (F.col("event_type") != "Dispossessed"), nxt).otherwise(0.0)
    return states.withColumns({"next_value": nxt, "action_value": after - F.col(value)})


def transitions(events: DataFrame) -> DataFrame:
    """How often each event type follows which, with the mean pause."""
    w = Window.partitionBy("match_id", "possession_id").orderBy("event_index")
    pause = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000000
    steps = events.withColumns({"next_type": F.lead("event_type").over(w), "pause_s": pause}).where("next_type is not null")
    return steps.groupBy("event_type", "next_type").agg(F.count("*").alias("n"), F.round(F.avg("pause_s"), 3).alias("mean_pause_s"))


def percentile(value: str, keys: list[str], least: int = K.LEAST_PEERS) -> Column:
    """Tie-aware percentile 100 * (average rank - 1) / (n - 1) among non-null peers; null with fewer than ``least``."""
    peers, v = Window.partitionBy(*keys, F.col(value).isNull()), F.col(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    rank = F.rank().over(peers.orderBy(v)) + (ties - 1) / 2
    n = F.count("*").over(peers)
    return F.when(v.isNotNull() & (n >= least), F.try_divide(F.lit(100.0) * (rank - 1), (n - 1).cast("double")))


def percentiles(profiles: DataFrame, ids: list[str], group: str, metrics: list[str], least: int = K.LEAST_PEERS) -> DataFrame:
    """Long table of metrics with their percentile in the group."""
    long = profiles.unpivot(ids + [group], metrics, "metric", "value")
    return long.withColumn("percentile", F.round(percentile("value", [group, "metric"], least), 6))


def zscores(profiles: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Population z-scores in the group, as ``z_<feature>``; null for a constant feature.

    Values are centred twice, the second time by the mean of what the first left: a running sum of many values of one sign is off by many
    roundings, which show in the last digits of distances.
    """
    w = Window.partitionBy(group)
    once = profiles.withColumns({f"_{f}": F.col(f) - F.avg(f).over(w) for f in features})
    return once.withColumns({f"z_{f}": F.try_divide(F.col(f"_{f}") - F.avg(f"_{f}").over(w), F.stddev_pop(f).over(w)) for f in features}).drop(*[f"_{f}" for f in features])


def halves(player_matches: DataFrame, player: str = "player_id", order: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """First and second half of each player's matches in their order; the first is the smaller one of an odd number."""
    w = Window.partitionBy(player).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(player))
    return player_matches.withColumns({"match_index": F.row_number().over(w) - 1, "half": F.when(F.row_number().over(w) - 1 < F.floor(n / 2), "first").otherwise("second")})


def first_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def transitions_in_space(rows: DataFrame, keys: list[str], order: list[str], carried: list[str], end: tuple[str, str], start: tuple[str, str]) -> DataFrame:
    """``rows`` that have a next one in their possession, with ``after_*`` of the carried columns and ``discrepancy``: from where the action ends to where the next begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = rows.withColumns({f"after_{c}": F.lead(c).over(w) for c in dict.fromkeys([*carried, *start])}).withColumn("_next", F.lead(F.lit(1)).over(w)).where("_next = 1").drop("_next")
    return after.withColumn("discrepancy", F.hypot(F.col(end[0]) - F.col(f"after_{start[0]}"), F.col(end[1]) - F.col(f"after_{start[1]}")))
