"""Registered queries on player intelligence, team and role profiles, and role fits of insiders and outsiders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import intelligence as I
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.operators import similarity as V
from touchline.operators.ordering import group_medians
from touchline.plans.base import query
from touchline.plans.profiles import FEATURES_SQL, PROFILE_SQL, features, passing_profile, style_profile_player, style_sql
from touchline.plans.vectors import DIMS, STYLE_VECTORS_SQL, style_vectors
from touchline.sources import views
from touchline.sources.scratch import stored
from touchline.sources.views import PASSES_SQL, SHOTS_SQL

# Player intelligence: thresholds lie inside the samples at hand, so that each reason occurs -----------------------------------

REGISTRY = [
    I.Metric("expected_completion_rate", "style", "passes", 100, "rate"),
    I.Metric("pressure_pass_rate", "style", "passes", 300, "rate", radar=True),
    I.Metric("progressive_pass_rate", "style", "passes", 400, "rate", radar=True),
    I.Metric("long_pass_rate", "style", "passes", 405, "rate", radar=True),
    I.Metric("carry_share", "style", "carries", 200, "rate"),
    I.Metric("pressure_above_expected_pp", "performance", "pressure_attempts", 90, "percentage_points", radar=True),
    I.Metric("long_above_expected_pp", "performance", "long_attempts", 20, "percentage_points"),
    I.Metric("sparse_rate", "performance", "sparse_attempts", 1, "rate"),
]
_SPARSE = "case when s.player_id % 3 > 0 then p.progressive_rate end as sparse_rate, p.progressive_attempts as sparse_attempts"
_PROFILES = f"select s.player_id, s.position_group, s.passes, s.carries, s.expected_completion_rate, s.pressure_pass_rate, s.progressive_pass_rate, s.long_pass_rate, s.carry_share, p.pressure_attempts, p.pressure_above_expected_pp, p.long_attempts, p.long_above_expected_pp, {_SPARSE} from ({style_sql('player_id, position_group')}) s join ({PROFILE_SQL}) p on s.player_id = p.player_id"
_METRICS_SQL = (
    f"with d as materialized ({_PROFILES}), l as (" + " union all ".join(f"select player_id, position_group, '{m.name}' as metric, '{m.family}' as family, {str(m.radar).lower()} as radar, {m.least} as least, '{m.sample}' as sample, {m.name}::double as raw_value, coalesce({m.sample}, 0)::bigint as sample_count from d" for m in REGISTRY) + "), "
    "k as (select *, raw_value is not null and sample_count >= least as ok from l), n as (select *, count(*) filter (ok) over (partition by metric, position_group) as peer_count, rank() over (partition by metric, position_group, ok order by raw_value) + (count(*) over (partition by metric, position_group, ok, raw_value) - 1)/2.0 as r from k), "
    "m as materialized (select *, case when ok and peer_count >= 10 then 100.0*(r - 1)/(peer_count - 1) end as percentile, ok and peer_count >= 10 as eligible, case when raw_value is null then 'metric_unavailable' when not ok then 'requires_' || least || '_' || sample when peer_count < 10 then 'requires_10_eligible_position_peers' else 'eligible' end as reason from n) "
)


def _profiles(spark, sf_dir):
    style = style_profile_player(spark, sf_dir).select("player_id", "position_group", "passes", "carries", "expected_completion_rate", "pressure_pass_rate", "progressive_pass_rate", "long_pass_rate", "carry_share")
    passing = passing_profile(spark, sf_dir).select("player_id", "pressure_attempts", "pressure_above_expected_pp", "long_attempts", "long_above_expected_pp", F.col("progressive_attempts").alias("sparse_attempts"), F.when(F.col("player_id") % 3 > 0, F.col("progressive_rate")).alias("sparse_rate"))
    return style.join(passing, "player_id")


@query("player_metrics", _METRICS_SQL + "select player_id, metric, family, round(raw_value, 6) as raw_value, sample_count, peer_count, round(percentile, 6) as percentile, eligible, reason from m")
def player_metrics(spark, sf_dir):
    """Every metric of every player with its peers, and why it has no percentile."""
    m = I.metric_rows(_profiles(spark, sf_dir), "player_id", "position_group", REGISTRY)
    return m.select("player_id", "metric", "family", F.round("raw_value", 6).alias("raw_value"), "sample_count", "peer_count", F.round("percentile", 6).alias("percentile"), "eligible", "reason")


@query(
    "player_radars",
    _METRICS_SQL + ", f as (select player_id, position_group, count(*) filter (family = 'style') as style_metrics, count(*) filter (family = 'performance') as performance_metrics, list_sort(coalesce(list(metric) filter (radar and percentile is not null), [])) as found from m group by 1, 2), "
    "t as (select *, case when position_group = 'GK' then 'limited_goalkeeper_profile' when len(found) < 3 then 'insufficient_eligible_metrics' else 'peer_percentiles' end as status from f) select player_id, position_group, style_metrics, performance_metrics, case when status = 'peer_percentiles' then array_to_string(found, ' ') else '' end as radar, status from t",
)
def player_radars(spark, sf_dir):
    r = I.radars(I.metric_rows(_profiles(spark, sf_dir), "player_id", "position_group", REGISTRY), "player_id", "position_group")
    return r.withColumn("radar", F.array_join("radar", " "))


@query("player_intelligence_page", _METRICS_SQL + "select metric, family, round(raw_value, 6) as raw_value, round(percentile, 6) as percentile, reason from m where player_id = 8 order by family desc, metric")
def player_intelligence_page(spark, sf_dir):
    m = I.metric_rows(_profiles(spark, sf_dir), "player_id", "position_group", REGISTRY)
    return m.where("player_id = 8").select("metric", "family", F.round("raw_value", 6).alias("raw_value"), F.round("percentile", 6).alias("percentile"), "reason").orderBy(F.desc("family"), "metric")


# Team and role profiles ----------------------------------------------------------------------------------------------------

_STYLE6 = ", ".join(f"round({f}, 6) as {f}" for f in P.STYLE)


@query(
    "team_profiles",
    f"with t as ({style_sql('team_id')}), c as (select team_id, any_value(team_name) as team_name, count(distinct player_id) as contributors from ({PASSES_SQL}) group by 1), s as (select team_id, count(*) as shots from ({SHOTS_SQL}) group by 1) select t.team_id, team_name, matches as matches_observed, contributors, passes, carries, actions, coalesce(shots, 0) as shots, {_STYLE6} from t join c on t.team_id = c.team_id left join s on t.team_id = s.team_id",
)
def team_profiles(spark, sf_dir):
    """Observed style of every team."""
    rows = features(spark, sf_dir)
    style = P.style_profile(rows, ["team_id"])
    named = rows.groupBy("team_id").agg(F.min("team_name").alias("team_name"), F.countDistinct("player_id").alias("contributors"))
    shots = views.shots(spark, sf_dir).groupBy("team_id").agg(F.count("*").alias("shots"))
    found = style.join(named, "team_id").join(shots, "team_id", "left")
    return found.select("team_id", "team_name", F.col("matches").alias("matches_observed"), "contributors", "passes", "carries", "actions", F.coalesce("shots", F.lit(0)).alias("shots"), *[F.round(f, 6).alias(f) for f in P.STYLE])


_ROLE_ROWS = f"select * from ({FEATURES_SQL}) where position_group <> 'GK'"
_STATS = "select position_group, " + ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in P.STYLE) + f" from ({style_sql('player_id, position_group')}) where position_group <> 'GK' and passes >= 50 and carries >= 29 group by 1"
_Z = ", ".join(f"round((r.{f} - m_{f})/s_{f}, 5) as z_{f}" for f in P.STYLE)


@query(
    "role_profiles",
    f"with r as ({style_sql('team_id, position_group', _ROLE_ROWS)}), p as (select team_id, position_group, player_id, player_name, count(*) as actions from ({_ROLE_ROWS}) group by 1, 2, 3, 4), q as (select *, round(actions/sum(actions) over (partition by team_id, position_group), 6) as share from p), "
    "c as (select team_id, position_group, count(*) as contributor_count, max(share) as top_share, string_agg(player_id || '=' || actions, ' ' order by actions desc, player_id) as contributors from q group by 1, 2), st as (" + _STATS + ") "
    "select r.team_id, r.position_group, matches as matches_observed, contributor_count, round(top_share, 6) as top_share, contributors, passes, carries, actions, case when contributor_count <= 3 then 'limited_contributor_diversity' else 'established' end as support_level, "
    f"case when contributor_count <= 3 then 'Limited contributor diversity: ' else '' end || 'Observed across ' || matches || ' matches and ' || contributor_count || ' contributing ' || r.position_group || ' players.' as support_message, {_Z} from r join c on r.team_id = c.team_id and r.position_group = c.position_group join st on r.position_group = st.position_group",
)
def role_profiles(spark, sf_dir):
    """A team's pooled role profiles on the players' statistics, with who made them."""
    rows = features(spark, sf_dir).where("position_group <> 'GK'")
    keys = ["team_id", "position_group"]
    made = I.contributors(rows, keys, "player_id", "player_name")
    stats = player_statistics(spark, sf_dir)
    z = I.onto_statistics(P.style_profile(rows, keys), stats, "position_group", P.STYLE).join(made, keys)
    level, message = I.role_support(F.col("position_group"), F.col("matches"), F.col("contributor_count"))
    listed = F.from_json("contributors", "array<struct<player_id:long,player_name:string,actions:long,action_share:double>>")
    short = F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["player_id"].cast("string"), x["actions"].cast("string"))), " ")
    return z.select(*keys, F.col("matches").alias("matches_observed"), "contributor_count", F.round("top_share", 6).alias("top_share"), short.alias("contributors"), "passes", "carries", "actions", level.alias("support_level"), message.alias("support_message"), *[F.round(f"z_{f}", 5).alias(f"z_{f}") for f in P.STYLE])


def player_statistics(spark, sf_dir):
    """Stored statistics of eligible players: (position_group, feature, mean, std)."""
    players = style_profile_player(spark, sf_dir).where("position_group <> 'GK' and passes >= 50 and carries >= 29")
    return players.unpivot(["position_group"], P.STYLE, "feature", "x").groupBy("position_group", "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


# Role fits: outsiders against the whole role, insiders against the role without themselves ------------------------------------

_GAPS = "list_value(" + ", ".join(f"struct_pack(g := round(abs(v[{i + 1}] - rv[{i + 1}]), 9), i := {i}, f := '{f}')" for i, f in enumerate(P.STYLE)) + ")"
_FIT_D = "sqrt((" + "+".join(f"(v[{i + 1}]-rv[{i + 1}])*(v[{i + 1}]-rv[{i + 1}])" for i in range(DIMS)) + f")/{DIMS})"


@query(
    "role_fits",
    f"with s as materialized ({STYLE_VECTORS_SQL}), m as (select player_id, count(distinct match_id) as matches from ({PASSES_SQL}) group by 1), t as (select team_id as target, position_group, count(*) as n, list_value({', '.join(f'sum(v[{i + 1}])' for i in range(DIMS))}) as t from s group by 1, 2), "
    f"j as (select target, s.*, t.n, s.team_id = target as own, case when s.team_id = target then list_value({', '.join(f'(t[{i + 1}] - v[{i + 1}])/nullif(n - 1, 0)' for i in range(DIMS))}) else list_value({', '.join(f't[{i + 1}]/n' for i in range(DIMS))}) end as rv from s join t on s.position_group = t.position_group), "
    f"k as (select *, {_FIT_D} as distance, list_sort({_GAPS}) as gaps from j where not own or n > 1), r as (select *, case when not own then row_number() over (partition by target, position_group, own order by round(distance, 9), player_id) end as rank from k) "
    "select target as target_team_id, r.player_id, position_group, own as is_target_team_player, case when own then 'leave_self_out_target_role' else 'full_target_role' end as calculation_scope, round(distance, 6) as role_distance, rank::integer as recommendation_rank, gaps[1].f as closest_feature_1, gaps[2].f as closest_feature_2, gaps[3].f as closest_feature_3, gaps[6].f as largest_difference, "
    "case when matches < 3 then 'limited' else 'higher' end as sample_support, case when own then n - 1 else n end as role_contributors from r join m on r.player_id = m.player_id",
)
def role_fits(spark, sf_dir):
    """Every team's roles: outsiders are ranked, insiders are held against the role without themselves."""
    s = style_vectors(spark, sf_dir)
    x = [F.get("v", F.lit(i)) for i in range(DIMS)]
    roles = s.groupBy(F.col("team_id").alias("target"), "position_group").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("t"))
    own = F.col("team_id") == F.col("target")
    part = lambda i: F.when(own, F.try_divide(F.get("t", F.lit(i)) - x[i], (F.col("n") - 1).cast("double"))).otherwise(F.get("t", F.lit(i)) / F.col("n"))
    joined = s.join(roles, "position_group").withColumns({"own": own, "rv": F.array(*[part(i) for i in range(DIMS)])}).where("not own or n > 1")
    gaps = F.array_sort(F.transform(V.gaps(F.col("v"), F.col("rv"), P.STYLE), lambda g: F.struct(F.round(g["gap"], 9).alias("gap"), g["place"].alias("place"), g["name"].alias("name"))))
    valued = joined.withColumns({"distance": V.rms(F.col("v"), F.col("rv")), "gaps": gaps})
    rank = F.row_number().over(Window.partitionBy("target", "position_group", "own").orderBy(F.round("distance", 9), "player_id"))  # shown values come from the whole distance: one rounded twice makes halves
    matches = views.passes(spark, sf_dir).groupBy("player_id").agg(F.countDistinct("match_id").alias("matches"))
    found = valued.withColumn("rank", F.when(~F.col("own"), rank)).join(matches, "player_id")
    level, _ = I.player_support(F.col("matches"))
    near = lambda i: F.get("gaps", F.lit(i))["name"]
    return found.select(
        F.col("target").alias("target_team_id"), "player_id", "position_group", F.col("own").alias("is_target_team_player"), F.when(F.col("own"), "leave_self_out_target_role").otherwise("full_target_role").alias("calculation_scope"), F.round("distance", 6).alias("role_distance"), F.col("rank").alias("recommendation_rank"),
        near(0).alias("closest_feature_1"), near(1).alias("closest_feature_2"), near(2).alias("closest_feature_3"), near(DIMS - 1).alias("largest_difference"), level.alias("sample_support"), F.when(F.col("own"), F.col("n") - 1).otherwise(F.col("n")).alias("role_contributors"),
    )


# Names and pages -----------------------------------------------------------------------------------------------------------


@query("teams_by_name", "select distinct cast(n_nationkey as bigint) as team_id, n_name as team_name from nation join supplier on s_nationkey = n_nationkey where contains(lower(n_name), lower('Tion_1')) order by team_name, team_id")
def teams_by_name(spark, sf_dir):
    """Teams whose name contains what was typed, in any case; wildcards stand for themselves."""
    return X.named_like(views.passes(spark, sf_dir).select("team_id", "team_name"), "team_name", "Tion_1").distinct().orderBy("team_name", "team_id")


@query("team_role_page", f"with t as ({style_sql('team_id, position_group', _ROLE_ROWS)}) select position_group, matches as matches_observed, passes, carries, actions, {_STYLE6} from t where team_id = 4 and position_group = 'DEF'")
def team_role_page(spark, sf_dir):
    rows = X.filtered(features(spark, sf_dir), "team_id", 4, equal={"position_group": I.outfield_role("DEF")})
    t = P.style_profile(rows, ["position_group"])
    return t.select("position_group", F.col("matches").alias("matches_observed"), "passes", "carries", "actions", *[F.round(f, 6).alias(f) for f in P.STYLE])


@query("target_team_players", f"select player_id, player_name, position_group, matches, passes, carries, {_STYLE6} from ({style_sql('player_id, player_name, position_group', f'select * from ({FEATURES_SQL}) where team_id = 4')})")
def target_team_players(spark, sf_dir):
    """Style of one team's players, from what they did for it."""
    t = P.style_profile(features(spark, sf_dir).where("team_id = 4"), ["player_id", "player_name", "position_group"])
    return t.select("player_id", "player_name", "position_group", "matches", "passes", "carries", *[F.round(f, 6).alias(f) for f in P.STYLE])


@query(
    "role_dominance",
    f"with p as (select team_id % 5 as club, position_group, player_id, count(*) as n from ({FEATURES_SQL}) where position_group <> 'GK' group by 1, 2, 3), q as (select *, n/sum(n) over (partition by club, position_group) as share, row_number() over (partition by club, position_group order by n desc, player_id) as r from p) "
    "select club, position_group, count(*) as players, round(max(share), 6) as top_share, round(sum(share) filter (r <= 2), 6) as top_two_share, round(sum(share*share), 6) as hhi, case when max(share) >= 0.4 or sum(share) filter (r <= 2) >= 0.65 then 'concentrated' else 'distributed' end as note from q group by 1, 2",
)
def role_dominance(spark, sf_dir):
    """Whether a few players make up a role of several teams taken together."""
    rows = features(spark, sf_dir).where("position_group <> 'GK'").withColumn("club", F.col("team_id") % 5)
    c = I.concentration(rows, ["club", "position_group"], "player_id")
    return c.select("club", "position_group", "players", *[F.round(x, 6).alias(x) for x in ("top_share", "top_two_share", "hhi")], "note")


_THREE = "team_id, match_id, position_group"


@query(
    "profile_of_three_sources",
    f"with p as (select {_THREE}, count(*) as passes, avg(expected_completion) as expected, avg(progressive::int) as progressive, sum(greatest(forward_distance, 0)) as forward from ({FEATURES_SQL}) where action_type = 'Pass' group by 1, 2, 3), a as (select {_THREE}, count(*) as actions, count(*) filter (action_type = 'Carry') as carries, sum(attacking_value) as value from ({FEATURES_SQL}) group by 1, 2, 3), s as (select {_THREE}, count(*) as shots, sum(expected_goal) as xg from ({SHOTS_SQL}) where position_group <> 'DEF' group by 1, 2, 3) "
    "select p.team_id, p.match_id, p.position_group, passes, coalesce(actions, 0) as actions, coalesce(carries, 0) as carries, coalesce(shots, 0) as shots, round(expected, 6) as expected_completion_rate, round(progressive, 6) as progressive_pass_rate, round(100*forward/passes, 4) as forward_per_100_passes, round(carries/actions::double, 6) as carry_share, round(100*value/actions, 6) as value_per_100_actions, round(xg/shots, 6) as xg_per_shot from p left join a using (team_id, match_id, position_group) left join s using (team_id, match_id, position_group)",
)
def profile_of_three_sources(spark, sf_dir):
    """Passes with what actions and shots say of the same team, match and role; where there is no shot, there is no rate of shots."""
    f, keys = features(spark, sf_dir), ["team_id", "match_id", "position_group"]
    passes = f.where("action_type = 'Pass'").groupBy(*keys).agg(F.count("*").alias("passes"), F.avg("expected_completion").alias("expected"), F.avg(F.col("progressive").cast("int")).alias("progressive"), F.sum(F.greatest("forward_distance", F.lit(0.0))).alias("forward"))
    actions = f.groupBy(*keys).agg(F.count("*").alias("actions"), P.total(F.col("action_type") == "Carry").alias("carries"), F.sum("attacking_value").alias("value"))
    shots = views.shots(spark, sf_dir).where("position_group <> 'DEF'").groupBy(*keys).agg(F.count("*").alias("shots"), F.sum("expected_goal").alias("xg"))
    j = P.beside(passes, keys, [actions, shots], ["actions", "carries", "shots"])
    share = lambda a, b, k=1.0: F.try_divide(F.col(a) * k, F.col(b).cast("double"))
    return j.select(*keys, "passes", "actions", "carries", "shots", F.round("expected", 6).alias("expected_completion_rate"), F.round("progressive", 6).alias("progressive_pass_rate"), F.round(share("forward", "passes", 100.0), 4).alias("forward_per_100_passes"), F.round(share("carries", "actions"), 6).alias("carry_share"), F.round(share("value", "actions", 100.0), 6).alias("value_per_100_actions"), F.round(share("xg", "shots"), 6).alias("xg_per_shot"))


_COUNTS = {"passes": "action_type = 'Pass'", "carries": "action_type = 'Carry'", "actions": "true", "progressive": "progressive", "pressure": "under_pressure"}


@query(
    "reliability_thresholds",
    f"with p as (select player_id, {', '.join(f'count(*) filter ({c}) as {n}' for n, c in _COUNTS.items())} from ({FEATURES_SQL}) group by 1), l as (unpivot p on {', '.join(_COUNTS)} into name kind value n), t as (select kind, greatest(1, ceil(median(n)))::bigint as threshold, count(*) as players from l group by 1) "
    "select kind, threshold, players, (select count(*) from l where l.kind = t.kind and n >= threshold) as reliable from t",
)
def reliability_thresholds(spark, sf_dir):
    """For each kind of count the least that half of the players reach, and how many do."""
    per = stored(features(spark, sf_dir).groupBy("player_id").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in _COUNTS.items()]).unpivot(["player_id"], list(_COUNTS), "kind", "n"), "counts")
    least = group_medians(per.withColumnRenamed("n", "v"), "kind", "v").select("kind", F.greatest(F.lit(1), F.ceil("median")).alias("threshold"))
    joined = per.join(F.broadcast(least), "kind")  # a row per kind
    return joined.groupBy("kind", "threshold").agg(F.count("*").alias("players"), F.count(F.when(F.col("n") >= F.col("threshold"), 1)).alias("reliable")).select("kind", "threshold", "players", "reliable")


_LOANED = "select *, case when player_id % 4 = 0 and match_id >= 20 then team_id + 100 else team_id end as club from ({s})"


@query(
    "multi_team_players",
    f"with c as (select player_id, club, count(distinct match_id) as matches, count(*) as actions from ({_LOANED.format(s=PASSES_SQL)}) group by 1, 2) select player_id, count(*) as clubs, string_agg(club || ':' || matches, ' ' order by actions desc, club) as matches_by_club, arg_max(club, actions*1000 - club) as main_club from c group by 1 having count(*) > 1",
)
def multi_team_players(spark, sf_dir):
    """Players who were seen for more than one team, with the one of most actions; some of the teams are exchanged from a match on."""
    club = F.when((F.col("player_id") % 4 == 0) & (F.col("match_id") >= 20), F.col("team_id") + 100).otherwise(F.col("team_id"))
    per = views.passes(spark, sf_dir).groupBy("player_id", club.alias("club")).agg(F.countDistinct("match_id").alias("matches"), F.count("*").alias("actions"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("actions")).alias("o"), "club", "matches")))  # a player's teams
    held = per.groupBy("player_id").agg(F.count("*").alias("clubs"), listed.alias("l")).where("clubs > 1")
    return held.select("player_id", "clubs", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["club"].cast("string"), x["matches"].cast("string"))), " ").alias("matches_by_club"), F.get("l", F.lit(0))["club"].alias("main_club"))
