"""Registered aggregations over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import pitch
from touchline.operators import profiles as P
from touchline.plans.base import query
from touchline.sources import views
from touchline.sources.views import PASSES_SQL, SHOTS_SQL

FEATURES_SQL = pitch.FEATURES_SQL.format(source=PASSES_SQL)
N = "count(*)"


def features(spark, sf_dir):
    return pitch.with_pass_features(views.passes(spark, sf_dir))


def _subset_sql(name: str, mask: str) -> str:
    n = f"count(*) filter ({mask})"
    done = f"cast(coalesce(sum(completed) filter ({mask}), 0) as bigint)"
    expected = f"sum(expected_completion) filter ({mask})"
    return (
        f"{n} as {name}_attempts, {done} as {name}_completed, round({done}/nullif({n},0)::double, 6) as {name}_rate, round({expected}/nullif({n},0), 6) as {name}_expected_rate, "
        f"round(100.0*({done}::double-{expected})/nullif({n},0), 6) as {name}_above_expected_pp, {n} >= {K.RELIABLE_SUBSET} as {name}_reliable"
    )


PROFILE_SQL = (
    f"select player_id, count(distinct match_id) as matches, {_subset_sql('all', 'true')}, {_subset_sql('pressure', 'under_pressure')}, {_subset_sql('progressive', 'progressive')}, "
    f"{_subset_sql('long', 'pass_length >= 30')}, round(count(*) filter (final_third_entry)/count(*)::double, 6) as final_third_rate from ({FEATURES_SQL}) group by player_id"
)


@query("passing_profile", PROFILE_SQL)
def passing_profile(spark, sf_dir):
    return P.passing_profile(features(spark, sf_dir))


@query("subset_metrics", f"select team_id, position_group, {_subset_sql('all', 'true')}, {_subset_sql('pressure', 'under_pressure')} from ({PASSES_SQL}) group by team_id, position_group")
def subset_metrics(spark, sf_dir):
    return views.passes(spark, sf_dir).groupBy("team_id", "position_group").agg(*P.subset_metrics("all", F.lit(True)), *P.subset_metrics("pressure", F.col("under_pressure")))


@query(
    "dominant_mode",
    f"select player_id, position as dominant_position, n as rows from (select player_id, position, count(*) as n, row_number() over (partition by player_id order by count(*) desc, position) as r from ({PASSES_SQL}) group by 1, 2) where r = 1",
)
def dominant_mode(spark, sf_dir):
    return P.dominant(views.passes(spark, sf_dir), "player_id", "position")


SHOOTING_SQL = (
    "select player_id, count(*) as shots, count(*) filter (goal) as goals, count(distinct match_id) as matches, round(sum(expected_goal), 6) as total_xg, round(sum(expected_goal)/count(*), 6) as xg_per_shot, "
    f"round(count(*) filter (goal) - sum(expected_goal), 6) as goals_minus_xg, count(*) >= {K.RELIABLE_SHOTS} as reliable from ({SHOTS_SQL}) group by player_id"
)


@query("shooting_profile", SHOOTING_SQL)
def shooting_profile(spark, sf_dir):
    return P.shooting_profile(views.shots(spark, sf_dir))


_MASKS = {"all": "true", "pass": "action_type = 'Pass'", "carry": "action_type = 'Carry'", "progressive": "progressive", "pressure": "under_pressure"}
_PER = ", ".join(f"count(*) filter ({m}) as {n}_actions, round(100.0*sum(attacking_value) filter ({m})/nullif(count(*) filter ({m}),0), 6) as {n}_per_100" for n, m in _MASKS.items())
ATTACKING_SQL = (
    f"with per as (select player_id, {_PER}, round(count(*) filter (attacking_value > 0)/count(*)::double, 6) as positive_rate from ({FEATURES_SQL}) group by player_id), "
    "t as (select greatest(1, ceil(median(all_actions)))::bigint as threshold from per) select per.*, threshold, all_actions >= threshold as reliable from per, t"
)


@query("attacking_profile", ATTACKING_SQL)
def attacking_profile(spark, sf_dir):
    return P.attacking_profile(features(spark, sf_dir))


@query(
    "action_tendencies",
    f"select player_id, count(*) as actions, count(*) filter (action_type = 'Carry') as carries, round(count(*) filter (action_type = 'Carry')/count(*)::double, 6) as carry_share, round(count(*) filter (progressive)/count(*)::double, 6) as progressive_share, "
    f"round(count(*) filter (under_pressure)/count(*)::double, 6) as pressure_share from ({FEATURES_SQL}) group by player_id",
)
def action_tendencies(spark, sf_dir):
    return P.action_tendencies(features(spark, sf_dir))


def style_sql(keys: str, source: str = FEATURES_SQL) -> str:
    n, p = "count(*)", "count(*) filter (action_type = 'Pass')"
    part = lambda m: f"round(count(*) filter (action_type = 'Pass' and {m})/nullif({p},0)::double, 6)"
    return (
        f"select {keys}, {n} as actions, {p} as passes, count(*) filter (action_type = 'Carry') as carries, count(distinct match_id) as matches, round(sum(expected_completion) filter (action_type = 'Pass')/nullif({p},0), 6) as expected_completion_rate, "
        f"{part('under_pressure')} as pressure_pass_rate, {part('progressive')} as progressive_pass_rate, {part('pass_length >= 30')} as long_pass_rate, "
        f"round(100.0*coalesce(sum(forward_distance) filter (action_type = 'Pass' and forward_distance > 0), 0)/nullif({p},0), 6) as forward_per_100_passes, round(count(*) filter (action_type = 'Carry')/{n}::double, 6) as carry_share from ({source}) group by {keys}"
    )


@query("style_profile_player", style_sql("player_id, position_group"))
def style_profile_player(spark, sf_dir):
    return P.style_profile(features(spark, sf_dir), ["player_id", "position_group"])


@query("style_profile_team_match", style_sql("match_id, team_id"))
def style_profile_team_match(spark, sf_dir):
    return P.style_profile(features(spark, sf_dir), ["match_id", "team_id"])


@query(
    "opponent_self_join",
    f"with s as ({style_sql('match_id, team_id')}) select a.match_id, a.team_id, count(*) as opponents, cast(sum(b.carries) as bigint) as opponent_carries, cast(sum(b.passes) as bigint) as opponent_passes from s a join s b on a.match_id = b.match_id and a.team_id <> b.team_id group by 1, 2",
)
def opponent_self_join(spark, sf_dir):
    s = P.style_profile(features(spark, sf_dir), ["match_id", "team_id"])
    a, b = s.select("match_id", "team_id").alias("a"), s.alias("b")
    joined = a.join(b, (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.team_id") != F.col("b.team_id")))
    return joined.groupBy("a.match_id", "a.team_id").agg(F.count("*").alias("opponents"), F.sum("b.carries").alias("opponent_carries"), F.sum("b.passes").alias("opponent_passes"))


@query(
    "team_coverage",
    f"select team_id, team_name, count(distinct match_id) as matches, count(distinct player_id) as players, count(*) as actions, count(*) filter (quantity >= 45) as shots, greatest(count(distinct match_id), count(distinct player_id)) as widest from ({PASSES_SQL}) group by 1, 2",
)
def team_coverage(spark, sf_dir):
    rows = views.passes(spark, sf_dir)
    matches, players = F.countDistinct("match_id"), F.countDistinct("player_id")
    return rows.groupBy("team_id", "team_name").agg(matches.alias("matches"), players.alias("players"), F.count("*").alias("actions"), P.total(F.col("quantity") >= 45).alias("shots"), F.greatest(matches, players).alias("widest"))


@query(
    "role_contributions_hhi",
    f"with c as (select team_id, position_group, player_id, count(*) as n from ({PASSES_SQL}) group by 1, 2, 3), s as (select *, n/sum(n) over (partition by team_id, position_group)::double as share, row_number() over (partition by team_id, position_group order by n desc, player_id) as r from c) "
    "select team_id, position_group, count(*) as members, round(max(share), 6) as top_share, round(sum(share) filter (r <= 2), 6) as top_two_share, round(sum(share*share), 6) as hhi from s group by 1, 2",
)
def role_contributions_hhi(spark, sf_dir):
    return P.contributions(views.passes(spark, sf_dir), ["team_id", "position_group"], "player_id")


@query(
    "weighted_means",
    f"with s as ({style_sql('player_id, position_group')}) select position_group, " + ", ".join(f"round(sum(actions*{f})/sum(actions) filter ({f} is not null), 6) as {f}" for f in P.STYLE) + " from s group by 1",
)
def weighted_means(spark, sf_dir):
    return P.weighted_means(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), ["position_group"], "actions", P.STYLE)


def _dist_sql(v: str, source: str, keys: str = "") -> str:
    q = ", ".join(f"round(quantile_cont({v}, {p}), 6) as p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"select {keys + ', ' if keys else ''}count({v}) as n, round(avg({v}), 6) as mean, round(stddev_pop({v}), 6) as std, min({v}) as least, max({v}) as most, {q} from ({source}) {'group by ' + keys if keys else ''}"


@query("distribution_summary", _dist_sql("attacking_value", PASSES_SQL))
def distribution_summary(spark, sf_dir):
    return P.distribution(views.passes(spark, sf_dir), "attacking_value")


THIRD = "case when start_x < 40 then 'Defensive' when start_x < 80 then 'Middle' else 'Attacking' end"


@query("grouped_distribution", _dist_sql("attacking_value", f"select *, {THIRD} as third from ({FEATURES_SQL})", "third, progressive"))
def grouped_distribution(spark, sf_dir):
    return P.distribution(features(spark, sf_dir).withColumn("third", pitch.third(F.col("start_x"))), "attacking_value", ["third", "progressive"])


@query("value_counts_share", f"select coalesce(position, 'Missing') as value, count(*) as n, round(count(*)/sum(count(*)) over ()::double, 6) as share from ({PASSES_SQL}) group by 1")
def value_counts_share(spark, sf_dir):
    return P.value_counts(views.passes(spark, sf_dir), "position")


@query("corpus_summary", "select o_orderstatus as competition, year(o_orderdate)::integer as season, count(distinct o_custkey) as customers, count(*) as orders from orders group by 1, 2")
def corpus_summary(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderstatus").alias("competition"), F.year("o_orderdate").alias("season")).agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders"))


@query("multi_position_players", f"select player_id, count(distinct position) as positions, count(distinct team_id) as teams from ({PASSES_SQL}) group by 1 having count(distinct position) > 1")
def multi_position_players(spark, sf_dir):
    rows = views.passes(spark, sf_dir).groupBy("player_id").agg(F.countDistinct("position").alias("positions"), F.countDistinct("team_id").alias("teams"))
    return rows.where("positions > 1")


@query("position_sets", f"select player_id, array_to_string(list_sort(list(distinct position)), '|') as positions, count(distinct position) as n from ({PASSES_SQL}) group by 1")
def position_sets(spark, sf_dir):
    listed = F.array_sort(F.collect_set("position"))
    return views.passes(spark, sf_dir).groupBy("player_id").agg(F.array_join(listed, "|").alias("positions"), F.size(listed).cast("bigint").alias("n"))


@query(
    "composition_zero_filled",
    f"with p as (select distinct team_id, player_id, position_group from ({PASSES_SQL})) select team_id, " + ", ".join(f"count(*) filter (position_group = '{g}') as {g.lower()}" for g in K.OUTFIELD) + ", round(100.0*count(*) filter (position_group = 'DEF')/count(*), 6) as def_percent from p group by 1",
)
def composition_zero_filled(spark, sf_dir):
    p = views.passes(spark, sf_dir).select("team_id", "player_id", "position_group").distinct()
    counts = [P.total(F.col("position_group") == g).alias(g.lower()) for g in K.OUTFIELD]
    return p.groupBy("team_id").agg(*counts, F.round(F.lit(100.0) * P.rate(P.total(F.col("position_group") == "DEF"), F.count("*")), 6).alias("def_percent"))


@query(
    "eta_squared",
    f"with s as ({style_sql('player_id, position_group')}), l as (unpivot (select position_group, {', '.join(P.STYLE)} from s) on {', '.join(P.STYLE)} into name feature value x), g as (select feature, position_group, count(x) as n, avg(x) as m, count(x)*var_pop(x) as within from l group by 1, 2), "
    "t as (select *, sum(n*m) over (partition by feature)/sum(n) over (partition by feature) as grand from g) select feature, round(coalesce(sum(n*(m-grand)*(m-grand))/nullif(sum(n*(m-grand)*(m-grand))+sum(within),0), 0), 6) as eta_squared, cast(sum(n) as bigint) as n from t group by 1",
)
def eta_squared(spark, sf_dir):
    return P.eta_squared(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), "position_group", P.STYLE)


_PAIRS = [(a, b) for i, a in enumerate(P.STYLE) for b in P.STYLE[i + 1 :]]


@query("pearson_pairs", f"with s as ({style_sql('player_id, position_group')}) " + " union all ".join(f"select '{a}' as left_feature, '{b}' as right_feature, round(corr({a}, {b}), 6) as r from s" for a, b in _PAIRS))
def pearson_pairs(spark, sf_dir):
    return P.correlations(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), P.STYLE)


def _avg_rank_sql(v: str, keys: str) -> str:
    return f"rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1)/2.0"


@query(
    "spearman",
    f"with s as ({style_sql('player_id, position_group')}), r as (select position_group, {_avg_rank_sql('progressive_pass_rate', 'position_group')} as ra, {_avg_rank_sql('long_pass_rate', 'position_group')} as rb from s) select position_group, count(*) as n, round(corr(ra, rb), 6) as rho from r group by 1",
)
def spearman(spark, sf_dir):
    return P.spearman(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), "progressive_pass_rate", "long_pass_rate", ["position_group"])


@query(
    "pass_features",
    f"select position_group, count(*) as n, round(avg(pass_length), 6) as mean_length, round(avg(forward_distance), 6) as mean_forward, round(avg(lateral_distance), 6) as mean_lateral, round(avg(sgd - egd), 6) as mean_gain, count(*) filter (progressive) as progressive, count(*) filter (final_third_entry) as entries from ({FEATURES_SQL}) group by 1",
)
def pass_features(spark, sf_dir):
    f = features(spark, sf_dir)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return f.groupBy("position_group").agg(
        F.count("*").alias("n"), mean("pass_length", "mean_length"), mean("forward_distance", "mean_forward"), mean("lateral_distance", "mean_lateral"),
        mean(F.col("start_goal_distance") - F.col("end_goal_distance"), "mean_gain"), P.total(F.col("progressive")).alias("progressive"), P.total(F.col("final_third_entry")).alias("entries"),
    )


ZONE = "case when {x} < 40 then 'defensive' when {x} < 80 then 'middle' else 'attacking' end || '_' || case when {y} < 80/3.0 then 'left' when {y} < 160/3.0 then 'centre' else 'right' end"


@query("pitch_zone_counts", f"select {ZONE.format(x='start_x', y='start_y')} as start_zone, {ZONE.format(x='end_x', y='end_y')} as end_zone, count(*) as n, round(avg(completed), 6) as rate from ({PASSES_SQL}) group by 1, 2")
def pitch_zone_counts(spark, sf_dir):
    return features(spark, sf_dir).groupBy("start_zone", "end_zone").agg(F.count("*").alias("n"), F.round(F.avg("completed"), 6).alias("rate"))


@query(
    "shot_geometry",
    f"select goal, count(*) as n, round(avg(sqrt((120-start_x)*(120-start_x)+(40-start_y)*(40-start_y))), 6) as mean_distance, round(avg(atan2(abs((120-start_x)*(44-start_y)-(120-start_x)*(36-start_y)), (120-start_x)*(120-start_x)+(36-start_y)*(44-start_y))), 6) as mean_angle from ({SHOTS_SQL}) group by 1",
)
def shot_geometry(spark, sf_dir):
    x, y = F.col("start_x"), F.col("start_y")
    return views.shots(spark, sf_dir).groupBy("goal").agg(F.count("*").alias("n"), F.round(F.avg(pitch.distance_to_goal(x, y)), 6).alias("mean_distance"), F.round(F.avg(pitch.angle_to_goal(x, y)), 6).alias("mean_angle"))


@query(
    "risk_reward",
    f"with m as (select median(expected_completion) as risk, median(attacking_value) as reward from ({PASSES_SQL})) select case when expected_completion < risk then 'high risk' else 'low risk' end || ', ' || case when attacking_value >= reward then 'high reward' else 'low reward' end as label, count(*) as n, round(avg(completed), 6) as rate from ({PASSES_SQL}), m group by 1",
)
def risk_reward(spark, sf_dir):
    rows = views.passes(spark, sf_dir)
    medians = rows.agg(F.median("expected_completion").alias("risk"), F.median("attacking_value").alias("reward"))  # one row
    label = F.concat(F.when(F.col("expected_completion") < F.col("risk"), "high risk").otherwise("low risk"), F.lit(", "), F.when(F.col("attacking_value") >= F.col("reward"), "high reward").otherwise("low reward"))
    return rows.crossJoin(F.broadcast(medians)).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("completed"), 6).alias("rate"))


@query(
    "eligibility_reasons",
    f"with s as ({style_sql('player_id, position_group')}) select player_id, coalesce(nullif(concat_ws(';', case when position_group = 'GK' then 'goalkeeper' end, case when passes < 400 then 'requires_400_passes' end, case when carries < 200 then 'requires_200_carries' end), ''), 'eligible') as reason from s",
)
def eligibility_reasons(spark, sf_dir):
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group"])
    reasons = F.concat_ws(";", F.when(F.col("position_group") == "GK", "goalkeeper"), F.when(F.col("passes") < 400, "requires_400_passes"), F.when(F.col("carries") < 200, "requires_200_carries"))
    return s.select("player_id", F.coalesce(F.nullif(reasons, F.lit("")), F.lit("eligible")).alias("reason"))


_GRID = [(p, c) for p in (300, 350, 400, 450) for c in (150, 200, 250)]


@query("threshold_grid", f"with s as ({style_sql('player_id, position_group')}) " + " union all ".join(f"select {p} as passes_at_least, {c} as carries_at_least, position_group, count(*) filter (passes >= {p} and carries >= {c}) as players from s group by position_group" for p, c in _GRID))
def threshold_grid(spark, sf_dir):
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group"])
    grid = spark.createDataFrame(_GRID, "passes_at_least int, carries_at_least int")
    counted = P.total((F.col("passes") >= F.col("passes_at_least")) & (F.col("carries") >= F.col("carries_at_least")))
    return s.crossJoin(F.broadcast(grid)).groupBy("passes_at_least", "carries_at_least", "position_group").agg(counted.alias("players"))  # a dozen thresholds
