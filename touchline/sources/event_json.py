"""Raw nested match events (JSON) as typed tables. The schema is given, never inferred: rare keys must always exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import clock_seconds

_NAMED = "struct<id:long,name:string>"
SCHEMA = (
    f"id string, index long, match_id long, period long, minute long, second long, timestamp string, possession long, type {_NAMED}, play_pattern {_NAMED}, possession_team {_NAMED}, team {_NAMED}, "
    f"player {_NAMED}, position {_NAMED}, location array<double>, under_pressure boolean, "
    f"pass struct<end_location:array<double>,outcome:{_NAMED},length:double,angle:double,height:{_NAMED},body_part:{_NAMED},type:{_NAMED}>, carry struct<end_location:array<double>>, dribble struct<outcome:{_NAMED}>, "
    f"shot struct<outcome:{_NAMED},type:{_NAMED},body_part:{_NAMED},technique:{_NAMED},first_time:boolean,one_on_one:boolean,open_goal:boolean,expected_goal:double>"
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path``; a file holds an array of events or one event per line group."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def xy(location: Column) -> tuple[Column, Column]:
    """Both coordinates if there are two finite numbers, else both null."""
    x, y = F.get(location, F.lit(0)), F.get(location, F.lit(1))
    big = F.lit(float("inf"))
    fine = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < big) & (F.abs(y) < big)
    return F.when(fine, x), F.when(fine, y)


def completed(outcome: Column) -> Column:
    """A pass without an outcome is complete."""
    return F.when(outcome["id"].isNull() & outcome["name"].isNull(), 1).otherwise(0)


def event_facts(events: DataFrame) -> DataFrame:
    """One flat row per event."""
    (sx, sy), (ex, ey) = xy(F.col("location")), xy(F.coalesce("pass.end_location", "carry.end_location"))
    kind = F.col("type.name")
    success = F.when(kind == "Pass", completed(F.col("pass.outcome")) == 1).when(kind == "Dribble", F.coalesce(F.col("dribble.outcome.name") == "Complete", F.lit(False))).otherwise(~kind.isin("Dispossessed", "Miscontrol"))
    return events.select(
        F.col("id").alias("event_id"), F.col("index").alias("event_index"), "match_id", "period", clock_seconds(F.col("timestamp")).alias("seconds"), F.col("possession").alias("possession_id"), kind.alias("event_type"),
        F.col("possession_team.id").alias("possession_team_id"), F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"), F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"), F.col("position.name").alias("position"),
        sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"), F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), success.alias("success"),
    )


def pass_facts(events: DataFrame) -> DataFrame:
    passes = events.where(F.col("type.name") == "Pass")
    (sx, sy), (ex, ey) = xy(F.col("location")), xy(F.col("pass.end_location"))
    return passes.select(
        F.col("id").alias("event_id"), "match_id", F.col("player.id").alias("player_id"), F.col("team.id").alias("team_id"), sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"),
        F.col("pass.length").alias("recorded_length"), F.col("pass.height.name").alias("height"), F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), completed(F.col("pass.outcome")).alias("completed"),
    )


def shot_facts(events: DataFrame) -> DataFrame:
    shots = events.where(F.col("type.name") == "Shot")
    x, y = xy(F.col("location"))
    penalty = F.coalesce(F.col("shot.type.name") == "Penalty", F.lit(False))
    return shots.select(
        F.col("id").alias("shot_id"), "match_id", F.col("player.id").alias("player_id"), x.alias("start_x"), y.alias("start_y"), (F.lower("shot.outcome.name") == "goal").alias("goal"), penalty.alias("penalty"), (F.col("period") == 5).alias("shootout"),
        (~penalty & (F.col("period") != 5) & x.isNotNull() & F.col("shot.outcome.name").isNotNull()).alias("eligible"), F.coalesce("shot.first_time", F.lit(False)).alias("first_time"), F.col("shot.expected_goal").alias("expected_goal"),
    )


def on_ball(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of the given types with coordinates, by the team in possession."""
    return facts.where(F.col("event_type").isin(kinds) & F.col("start_x").isNotNull() & (F.col("team_id") == F.col("possession_team_id")) & F.col("possession_id").isNotNull())
