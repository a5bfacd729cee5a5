"""Registered role queries that leave parts out: recommendations for one team and role, and role vectors without the player itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import profiles as P
from touchline.plans.base import query
from touchline.plans.vectors import DIMS, ROLE_SQL, STYLE_VECTORS_SQL, _role_distances, style_vectors


@query("recommendations", ROLE_SQL + " select player_id, round(distance, 6) as distance, (select count(*) from d where team_id = 4 and position_group = 'DEF') as cohort from d where team_id = 4 and position_group = 'DEF' order by round(d.distance, 9), player_id limit 10")
def recommendations(spark, sf_dir):
    """The ten best external candidates for one team's role, with the size of the cohort."""
    cohort = _role_distances(spark, sf_dir).where("team_id = 4 and position_group = 'DEF'")
    size = cohort.agg(F.count("*").alias("cohort"))  # one row
    top = cohort.orderBy("distance", "player_id").limit(10).select("player_id", F.round("distance", 6).alias("distance"))
    return top.crossJoin(F.broadcast(size))


@query(
    "leave_self_out_role",
    f"with s as ({STYLE_VECTORS_SQL}), t as (select team_id, position_group, count(*) as n, " + ", ".join(f"sum(v[{i + 1}]) as t{i}" for i in range(DIMS)) + " from s group by 1, 2) "
    "select player_id, n - 1 as others, round(sqrt((" + "+".join(f"(v[{i + 1}]-(t{i}-v[{i + 1}])/nullif(n-1,0))*(v[{i + 1}]-(t{i}-v[{i + 1}])/nullif(n-1,0))" for i in range(DIMS)) + f")/{DIMS}), 6) as distance from s join t on s.team_id = t.team_id and s.position_group = t.position_group",
)
def leave_self_out_role(spark, sf_dir):
    """A player's distance to the mean of the team's other players of the role: the whole less the own part; null without others."""
    s = style_vectors(spark, sf_dir)
    whole = s.groupBy("team_id", "position_group").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"t{i}") for i in range(DIMS)])
    own = [F.get("v", F.lit(i)) for i in range(DIMS)]
    gaps = [x - P.rate(F.col(f"t{i}") - x, F.col("n") - 1) for i, x in enumerate(own)]
    total = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    return s.join(whole, ["team_id", "position_group"]).select("player_id", (F.col("n") - 1).alias("others"), F.round(F.sqrt(total / DIMS), 6).alias("distance"))
