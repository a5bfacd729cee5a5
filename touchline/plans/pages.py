"""Registered pages, boards, archetypes, reports and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import profiles as P
from touchline.operators import reports as R
from touchline.operators import selection as X
from touchline.operators import similarity as V
from touchline.plans.base import query
from touchline.plans.profiles import ATTACKING_SQL, FEATURES_SQL, PROFILE_SQL, attacking_profile, features, passing_profile, style_sql
from touchline.plans.sequences import STATES_SQL, states
from touchline.plans.vectors import _RMS, _pairs_sql, style_vectors
from touchline.sources import views
from touchline.sources.views import PASSES_SQL, SHOTS_SQL

PLAYERS_SQL = "select s_suppkey as player_id, s_name as player_name, n_name as team_name from supplier join nation on s_nationkey = n_nationkey"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def players(spark, sf_dir):
    supplier, nation = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player_name"), F.col("n_name").alias("team_name"))


# Leaderboards: metric -> (profile, value, sample, gate) --------------------------------------------------------------

_BOARDS = {
    "pressure_above_expected": ("passing", "pressure_above_expected_pp", "pressure_attempts", "pressure_reliable"),
    "progressive_above_expected": ("passing", "progressive_above_expected_pp", "progressive_attempts", "progressive_reliable"),
    "long_above_expected": ("passing", "long_above_expected_pp", "long_attempts", "long_reliable"),
    "final_third_rate": ("passing", "final_third_rate", "all_attempts", "all_reliable"),
    "expected_rate": ("passing", "all_expected_rate", "all_attempts", "all_reliable"),
    "progressive_share": ("passing", "round(progressive_attempts/cast(all_attempts as double), 6)", "all_attempts", "all_reliable"),
    "pass_value": ("attacking", "pass_per_100", "pass_actions", "reliable"),
    "carry_value": ("attacking", "carry_per_100", "carry_actions", "reliable"),
    "progressive_value": ("attacking", "progressive_per_100", "progressive_actions", "reliable"),
    "pressure_value": ("attacking", "pressure_per_100", "pressure_actions", "reliable"),
}


def _board(name: str, profile: str, value: str, sample: str, gate: str) -> None:
    source = PROFILE_SQL if profile == "passing" else ATTACKING_SQL
    rows = f"select player_id, {value} as value, {sample} as sample from ({source}) where {gate} and {value} is not null"

    @query(f"leaderboard_{name}", f"select b.player_id, player_name, team_name, value, sample, row_number() over (order by value desc, b.player_id)::integer as rank from ({rows}) b join ({PLAYERS_SQL}) p on b.player_id = p.player_id qualify rank <= 25")
    def board(spark, sf_dir):
        found = (passing_profile if profile == "passing" else attacking_profile)(spark, sf_dir)
        top = X.leaderboard(found.where(gate).selectExpr("player_id", f"{value} as value", f"{sample} as sample"), "value", gate=F.lit(True))
        return top.join(players(spark, sf_dir), "player_id").select("player_id", "player_name", "team_name", "value", "sample", "rank")


for _name, _parts in _BOARDS.items():
    _board(_name, *_parts)


# Pages with optional filters -----------------------------------------------------------------------------------------

_PAGE_ORDER = "match_id, order_key, match_number, start_x"


@query("player_passes_page", f"select match_id, order_key, match_number, completed, under_pressure, round(pass_length, 6) as pass_length, round(expected_completion, 6) as expected_completion from ({FEATURES_SQL}) where player_id = 3 and action_type = 'Pass' and under_pressure and pass_length >= 10 and pass_length <= 60 order by {_PAGE_ORDER} limit 500")
def player_passes_page(spark, sf_dir):
    rows = features(spark, sf_dir).where("action_type = 'Pass'")
    found = X.filtered(rows, "player_id", 3, equal={"under_pressure": True}, between={"pass_length": (10, 60)})
    page = found.orderBy(*_PAGE_ORDER.split(", ")).limit(500)
    return page.select("match_id", "order_key", "match_number", "completed", "under_pressure", F.round("pass_length", 6).alias("pass_length"), F.round("expected_completion", 6).alias("expected_completion"))


@query("player_shots_page", f"select match_id, order_key, match_number, goal, round(expected_goal, 6) as expected_goal from ({SHOTS_SQL}) where player_id = 5 and expected_goal >= 0.1 order by {_PAGE_ORDER} limit 500")
def player_shots_page(spark, sf_dir):
    found = X.filtered(views.shots(spark, sf_dir), "player_id", 5, between={"expected_goal": (0.1, None)})
    return found.orderBy(*_PAGE_ORDER.split(", ")).limit(500).select("match_id", "order_key", "match_number", "goal", F.round("expected_goal", 6).alias("expected_goal"))


@query("player_actions_filtered", f"select match_id, order_key, match_number, action_type, round(attacking_value, 6) as attacking_value from ({FEATURES_SQL}) where player_id = 4 and action_type = 'Carry' and progressive and not under_pressure and match_id <= 20 and attacking_value >= 0 order by attacking_value desc, {_PAGE_ORDER} limit 500")
def player_actions_filtered(spark, sf_dir):
    found = X.filtered(features(spark, sf_dir), "player_id", 4, equal={"action_type": "Carry", "progressive": True, "under_pressure": False, "completed": None}, between={"match_id": (None, 20), "attacking_value": (0, None)})
    shown = found.withColumn("attacking_value", F.round("attacking_value", 6))
    page = shown.orderBy(F.desc("attacking_value"), *_PAGE_ORDER.split(", ")).limit(500)
    return page.select("match_id", "order_key", "match_number", "action_type", "attacking_value")


@query("similar_players_page", _pairs_sql(_RMS) + f", r as (select *, row_number() over (partition by left_id order by round(distance, 9), right_id)::integer as rank from d) select r.left_id as player_id, p.player_id as similar_id, player_name, team_name, rank, round(distance, 6) as distance from r join ({PLAYERS_SQL}) p on r.right_id = p.player_id where rank <= 10")
def similar_players_page(spark, sf_dir):
    """The ten most similar players of each, with their names."""
    top = V.neighbours(style_vectors(spark, sf_dir), "player_id", "position_group", "v")
    named = top.join(players(spark, sf_dir).withColumnRenamed("player_id", "similar_id"), F.col("right_id") == F.col("similar_id"))
    return named.select(F.col("left_id").alias("player_id"), "similar_id", "player_name", "team_name", "rank", F.round("distance", 6).alias("distance"))


# Archetypes: the labels of the embeddings and their centroids ---------------------------------------------------------

_D = 64
_CENTRES = "c as (select label, " + ", ".join(f"avg(embedding[{i + 1}]::double) as c{i}" for i in range(_D)) + " from embeddings group by 1)"
_DISTANCE = "sqrt((" + "+".join(f"(embedding[{i + 1}]-c{i})*(embedding[{i + 1}]-c{i})" for i in range(_D)) + f")/{_D})"
_OWN = f"with {_CENTRES}, o as (select vec_id, e.label, round({_DISTANCE}, 5) as distance from embeddings e join c on e.label = c.label)"


def _embedded(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _own_distances(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    return e.join(R.centroids(e, "label", "v", _D), "label").select("vec_id", "label", F.round(V.rms(F.col("v"), F.col("centre")), 5).alias("distance"))


@query("archetype_representatives", _OWN + " select label, vec_id, distance, row_number() over (partition by label order by distance, vec_id)::integer as place from o qualify place <= 5")
def archetype_representatives(spark, sf_dir):
    order = Window.partitionBy("label").orderBy("distance", "vec_id")
    return _own_distances(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 5").select("label", "vec_id", "distance", "place")


@query("archetype_catalogue", _OWN + " select label, count(*) as members, round(count(*)/sum(count(*)) over ()::double, 6) as share, round(avg(distance), 4) as mean_distance, max(distance) as radius from o group by label")
def archetype_catalogue(spark, sf_dir):
    per = _own_distances(spark, sf_dir).groupBy("label").agg(F.count("*").alias("members"), F.round(F.avg("distance"), 4).alias("mean_distance"), F.max("distance").alias("radius"))
    return per.select("label", "members", F.round(F.col("members") / F.sum("members").over(Window.partitionBy()), 6).alias("share"), "mean_distance", "radius")  # a row per label


@query("archetype_boundary", f"with {_CENTRES}, d as (select vec_id, c.label, {_DISTANCE} as d from embeddings, c), r as (select *, row_number() over (partition by vec_id order by d, label) as r from d) select vec_id, round(max(d) filter (r = 2) - max(d) filter (r = 1), 5) as margin from r where r <= 2 group by 1 order by margin, vec_id limit 10")
def archetype_boundary(spark, sf_dir):
    """The ten rows with the smallest margins between the nearest and the second centroid."""
    e = _embedded(spark, sf_dir)
    m = V.margins(e, "vec_id", "v", R.centroids(e, "label", "v", _D), "label", "centre")
    return m.select("vec_id", F.round("margin", 5).alias("margin")).orderBy("margin", "vec_id").limit(10)


_ARCHETYPE_SQL = f"select player_id, position_group, case when forward_per_100_passes >= median(forward_per_100_passes) over (partition by position_group) then 'direct' else 'patient' end as archetype from ({style_sql('player_id, position_group, team_id')}) where position_group <> 'GK' and passes >= 50 and carries >= 29"


def _archetypes(spark, sf_dir):
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group", "team_id"]).where("position_group <> 'GK' and passes >= 50 and carries >= 29")
    middle = F.median("forward_per_100_passes").over(Window.partitionBy("position_group"))
    return s.select("player_id", "position_group", F.when(F.col("forward_per_100_passes") >= middle, "direct").otherwise("patient").alias("archetype"))


@query("archetype_players", f"select a.player_id, player_name, position_group, archetype from ({_ARCHETYPE_SQL}) a join ({PLAYERS_SQL}) p on a.player_id = p.player_id")
def archetype_players(spark, sf_dir):
    return _archetypes(spark, sf_dir).join(players(spark, sf_dir), "player_id").select("player_id", "player_name", "position_group", "archetype")


@query("neighbour_archetypes", _pairs_sql(_RMS) + f", a as ({_ARCHETYPE_SQL}), n as (select *, row_number() over (partition by left_id order by round(distance, 9), right_id) as rank from d) select x.archetype as archetype, y.archetype as neighbour_archetype, count(*) as pairs from n left join a x on left_id = x.player_id left join a y on right_id = y.player_id where rank <= 10 group by 1, 2")
def neighbour_archetypes(spark, sf_dir):
    """Archetypes on both sides of the ten nearest neighbours."""
    a = _archetypes(spark, sf_dir)
    top = V.neighbours(style_vectors(spark, sf_dir), "player_id", "position_group", "v")
    mine = a.select(F.col("player_id").alias("left_id"), "archetype")
    theirs = a.select(F.col("player_id").alias("right_id"), F.col("archetype").alias("neighbour_archetype"))
    return top.join(mine, "left_id", "left").join(theirs, "right_id", "left").groupBy("archetype", "neighbour_archetype").agg(F.count("*").alias("pairs"))


# Eligibility and the style matrix -------------------------------------------------------------------------------------

_REQUIRED = {"pressure_rate": ("pressure_attempts", 25, "pressure_passes"), "long_rate": ("long_attempts", 40, "long_passes"), "final_third_rate": ("all_attempts", 100, "passes")}
_PEERS = 5
_GROUPED = f"select distinct player_id, position_group from ({PASSES_SQL})"


def _metric_rows_sql() -> str:
    each = " union all ".join(f"select p.player_id, position_group, '{m}' as metric, {m} as value, {s}::bigint as sample, {n} as needed, '{k}' as kind from ({PROFILE_SQL}) p join ({_GROUPED}) g on p.player_id = g.player_id" for m, (s, n, k) in _REQUIRED.items())
    return f"select *, count(*) filter (value is not null and sample >= needed) over (partition by metric, position_group) as peers from ({each})"


@query("metric_eligibility", f"select player_id, metric, case when value is null then 'metric_unavailable' when sample < needed then 'requires_' || needed || '_' || kind when peers < {_PEERS} then 'requires_{_PEERS}_eligible_position_peers' else 'eligible' end as reason, peers from ({_metric_rows_sql()})")
def metric_eligibility(spark, sf_dir):
    profile = passing_profile(spark, sf_dir).join(views.passes(spark, sf_dir).select("player_id", "position_group").distinct(), "player_id")
    return R.metric_eligibility(profile, "player_id", "position_group", _REQUIRED, _PEERS).select("player_id", "metric", "reason", "peers")


_MATRIX = ", ".join(f"max(value) filter (metric = '{m}') as {m}, max(sample) filter (metric = '{m}') as {m}__sample_count, bool_or(value is not null and sample >= needed and peers >= {_PEERS}) filter (metric = '{m}') as {m}__eligible" for m in _REQUIRED)


@query("style_matrix", f"select player_id, position_group, {_MATRIX} from ({_metric_rows_sql()}) group by 1, 2")
def style_matrix(spark, sf_dir):
    profile = passing_profile(spark, sf_dir).join(views.passes(spark, sf_dir).select("player_id", "position_group").distinct(), "player_id")
    long = R.metric_eligibility(profile, "player_id", "position_group", _REQUIRED, _PEERS)
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    columns = [x for m in _REQUIRED for x in (of(m, "value").alias(m), of(m, "sample").alias(f"{m}__sample_count"), F.max(F.when(F.col("metric") == m, F.col("reason") == "eligible")).alias(f"{m}__eligible"))]
    return long.groupBy("player_id", "position_group").agg(*columns)


# Team matches ---------------------------------------------------------------------------------------------------------

_CHRONOLOGY = "select o_orderkey % 34 as match_id, min(o_orderdate)::date as played from orders group by 1"
_VENUE = "case when (match_id + team_id) % 2 = 0 then 'home' else 'away' end"


@query("team_match_chronology", f"select team_id, t.match_id, played, {_VENUE.replace('match_id', 't.match_id')} as venue, actions, row_number() over (partition by team_id order by played, t.match_id) as ordinal from (select team_id, match_id, count(*) as actions from ({PASSES_SQL}) group by 1, 2) t left join ({_CHRONOLOGY}) c on t.match_id = c.match_id")
def team_match_chronology(spark, sf_dir):
    played = _read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 34).alias("match_id")).agg(F.min("o_orderdate").cast("date").alias("played"))
    per = views.passes(spark, sf_dir).groupBy("team_id", "match_id").agg(F.count("*").alias("actions"))
    order = Window.partitionBy("team_id").orderBy("played", "match_id")
    return per.join(played, "match_id", "left").select("team_id", "match_id", "played", F.expr(_VENUE).alias("venue"), "actions", F.row_number().over(order).cast("long").alias("ordinal"))


@query("home_away_means", f"select team_id, {_VENUE} as venue, count(distinct match_id) as matches, round(avg(completed), 6) as completion, round(avg(attacking_value), 6) as attacking_value from ({PASSES_SQL}) group by 1, 2")
def home_away_means(spark, sf_dir):
    rows = views.passes(spark, sf_dir).groupBy("team_id", F.expr(_VENUE).alias("venue"))
    return rows.agg(F.countDistinct("match_id").alias("matches"), F.round(F.avg("completed"), 6).alias("completion"), F.round(F.avg("attacking_value"), 6).alias("attacking_value"))


# Possession geometry: the actions of an order are a possession ---------------------------------------------------------

_POSS = "partition by order_key order by match_number, start_x, end_x, player_id, quantity, attacking_value"


@query(
    "possession_geometry",
    f"select order_key, match_number, round(start_x - first_x, 6) as x_progress, previous_success, case when next_x is null then null else round(sqrt((next_x - end_x)*(next_x - end_x) + (next_y - end_y)*(next_y - end_y)), 6) end as next_start_distance from (select *, first_value(start_x) over ({_POSS}) as first_x, coalesce(lag(completed = 1) over ({_POSS}), false) as previous_success, lead(start_x) over ({_POSS}) as next_x, lead(start_y) over ({_POSS}) as next_y from ({PASSES_SQL}))",
)
def possession_geometry(spark, sf_dir):
    """Signed progress from the possession's start, success of the action before, and the distance from an action's end to where the next begins."""
    return R.possession_geometry(views.passes(spark, sf_dir), ["order_key"], ["match_number", "start_x", "end_x", "player_id", "quantity", "attacking_value"])


_BAND = "case when action_number <= 1 then '1' when action_number <= 3 then '2-3' when action_number <= 5 then '4-5' when action_number <= 10 then '6-10' else '11+' end"


@query("action_number_bands", f"select {_BAND} as band, count(*) as n, round(avg(elapsed_s::double), 3) as mean_elapsed from ({STATES_SQL}) group by 1")
def action_number_bands(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.groupBy(T.action_number_band(F.col("action_number")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("elapsed_s"), 3).alias("mean_elapsed"))


@query("difficulty_bands", f"select case when expected_completion < 0.6 then 'difficult' when expected_completion <= 0.85 then 'moderate' else 'easy' end as difficulty, count(*) as passes, round(avg(completed), 6) as rate from ({PASSES_SQL}) group by 1")
def difficulty_bands(spark, sf_dir):
    rows = views.passes(spark, sf_dir)
    return rows.groupBy(T.difficulty_band(F.col("expected_completion")).alias("difficulty")).agg(F.count("*").alias("passes"), F.round(F.avg("completed"), 6).alias("rate"))


# Distribution reports -------------------------------------------------------------------------------------------------

_STYLE_ROWS = style_sql("player_id, position_group, team_id")
_LONG = " union all ".join(f"select position_group, '{f}' as feature, {f} as value from s" for f in P.STYLE)


@query("group_location", f"with s as ({_STYLE_ROWS}), l as ({_LONG}), g as (select feature, avg(value) as m from l group by 1), e as (select l.feature, sum((gm - m)*(gm - m))/nullif(sum((value - m)*(value - m)), 0) as eta from (select *, avg(value) over (partition by feature, position_group) as gm from l where value is not null) l join g on l.feature = g.feature group by 1) select l.feature, position_group, count(value) as n, round(avg(value), 4) as mean, round(median(value), 4) as median, round(max(eta), 4) as eta_squared from l join e on l.feature = e.feature group by 1, 2")
def group_location(spark, sf_dir):
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group", "team_id"])
    return R.group_location(s, "position_group", P.STYLE)


@query("feature_availability", f"with s as (select * replace (case when player_id % 7 <> 3 then long_pass_rate end as long_pass_rate, case when player_id % 5 <> 0 then carry_share end as carry_share) from ({_STYLE_ROWS})), l as ({_LONG}) select feature, position_group, count(*) as rows, count(value) as available, round(1 - count(value)/count(*)::double, 6) as missing_share from l group by 1, 2")
def feature_availability(spark, sf_dir):
    """How many values of each feature there are; two features are taken from some players."""
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group", "team_id"])
    s = s.withColumns({"long_pass_rate": F.when(F.col("player_id") % 7 != 3, F.col("long_pass_rate")), "carry_share": F.when(F.col("player_id") % 5 != 0, F.col("carry_share"))})
    return R.availability(s, "position_group", P.STYLE)


_SCORED = f"select least(expected_completion, 1.0) as p, completed as y from ({PASSES_SQL})"


@query("calibration_left_closed", f"select least(floor(p*10 + 1e-9), 9)::integer as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from ({_SCORED}) group by 1")
def calibration_left_closed(spark, sf_dir):
    rows = views.actions(spark, sf_dir).select(F.least("expected_completion", F.lit(1.0)).alias("p"), F.col("completed").alias("y"))
    return R.left_closed_bins(rows, "p", "y", 10)


@query("pr_auc", f"with t as (select round(p, 9) as p, count(*) as n, sum(y) as pos from ({_SCORED}) group by 1), c as (select p, pos, sum(pos) over w as tp, sum(n) over w as seen, sum(pos) over () as total from t window w as (order by p desc)) select round(sum(pos/total::double * tp/seen::double), 6) as average_precision from c")
def pr_auc(spark, sf_dir):
    rows = views.actions(spark, sf_dir).select(F.least("expected_completion", F.lit(1.0)).alias("p"), F.col("completed").alias("y"))
    return R.average_precision(rows, "p", "y")


@query(
    "normalised_mutual_information",
    f"with x as (select case when completed = 1 then 'a' else 'b' end as u, position_group as v from ({PASSES_SQL})), j as (select u, v, count(*)::double as n from x group by 1, 2), t as (select *, sum(n) over () as total, sum(n) over (partition by u) as a, sum(n) over (partition by v) as b from j), m as (select sum(n/total * ln(n*total/(a*b))) as mi from t), hu as (select -sum(a/total*ln(a/total)) as h from (select distinct u, a, total from t)), hv as (select -sum(b/total*ln(b/total)) as h from (select distinct v, b, total from t)) select round(mi/((hu.h + hv.h)/2), 6) as nmi from m, hu, hv",
)
def normalised_mutual_information(spark, sf_dir):
    rows = views.passes(spark, sf_dir).select(F.when(F.col("completed") == 1, "a").otherwise("b").alias("u"), F.col("position_group").alias("v"))
    return R.nmi(rows, "u", "v")


_ALL_MEANS = "m as (select " + ", ".join(f"avg(embedding[{i + 1}]::double) as m{i}" for i in range(_D)) + " from embeddings)"
_WITHIN = "+".join(f"(embedding[{i + 1}]-c{i})*(embedding[{i + 1}]-c{i})" for i in range(_D))
_BETWEEN = "+".join(f"(c{i}-m{i})*(c{i}-m{i})" for i in range(_D))


@query("calinski_harabasz", f"with {_CENTRES}, {_ALL_MEANS}, k as (select label, count(*) as n from embeddings group by 1), w as (select sum({_WITHIN}) as w, count(*) as n from embeddings e join c on e.label = c.label), b as (select sum(n*({_BETWEEN})) as b, count(*) as k from c join k on c.label = k.label, m) select round((b/(k - 1))/(w/(n - k)), 3) as score from w, b")
def calinski_harabasz(spark, sf_dir):
    return R.calinski_harabasz(_embedded(spark, sf_dir), "label", "v", _D)


# Splits, evaluation, costs --------------------------------------------------------------------------------------------


@query("split_80_10_10", f"select match_id, case when r <= floor(0.8*n) then 'train' when r <= floor(0.9*n) then 'validation' else 'test' end as part from (select match_id, row_number() over (order by md5(match_id::varchar), match_id) as r, count(*) over () as n from (select distinct match_id from ({PASSES_SQL})))")
def split_80_10_10(spark, sf_dir):
    return X.three_way_split(views.actions(spark, sf_dir), "match_id")


_CHECKS = "select conv_id, role, case when role = 'user' then null else length(text) >= 40 end as long_enough, text like '%.%' as sentences from conversations"


@query("evaluation_aggregates", f"select role, count(*) filter (long_enough) as long_numerator, count(long_enough) as long_denominator, round(count(*) filter (long_enough)/nullif(count(long_enough), 0)::double, 6) as long_rate, count(*) filter (sentences) as sentence_numerator, count(sentences) as sentence_denominator, round(count(*) filter (sentences)/nullif(count(sentences), 0)::double, 6) as sentence_rate from ({_CHECKS}) group by 1")
def evaluation_aggregates(spark, sf_dir):
    """Rates over the cases that a check applies to; a null outcome doesn't apply."""
    rows = _read(spark, sf_dir, "conversations").select("role", F.when(F.col("role") != "user", F.length("text") >= 40).alias("long"), F.contains("text", F.lit(".")).alias("sentence"))
    return rows.groupBy("role").agg(*R.rates("long"), *R.rates("sentence"))


_PRICES = {"assistant": (3.0, 0.3), "user": (0.25, 0.025)}
"""Price of a million units, and of cached ones, by role."""


@query("turn_costs", "select role, count(*) as turns, case when role in ('assistant', 'user') then round(sum((length(text) - least(length(text), 100)) * case role when 'assistant' then 3.0 else 0.25 end + least(length(text), 100) * case role when 'assistant' then 0.3 else 0.025 end)/1e6, 9) end as cost from conversations group by 1")
def turn_costs(spark, sf_dir):
    """Costs with a lower price for cached units; null for a role without a price."""
    n = F.length("text").cast("long")
    rows = _read(spark, sf_dir, "conversations").select("role", T.cost(n, F.least(n, F.lit(100)), F.col("role"), _PRICES).alias("cost"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.sum("cost"), 9).alias("cost"))


@query("first_of_equal_turns", "select conv_id, min(turn) as turn, count(*) as times from (select conv_id, turn, role, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') as call from conversations) group by conv_id, role, call")
def first_of_equal_turns(spark, sf_dir):
    """Calls that are the same in canonical form count once, where they come first."""
    call = F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")
    return _read(spark, sf_dir, "conversations").groupBy("conv_id", "role", call.alias("call")).agg(F.min("turn").alias("turn"), F.count("*").alias("times")).select("conv_id", "turn", "times")
