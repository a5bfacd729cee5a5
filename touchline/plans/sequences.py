"""Registered window queries over ordered events and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import profiles as P
from touchline.operators import sequences as S
from touchline.plans.base import query
from touchline.plans.profiles import FEATURES_SQL, features, style_sql
from touchline.sources import views
from touchline.sources.views import EVENTS_SQL, PASSES_SQL

_MATCH = "partition by match_id order by ts, event_id"
POSSESSIONS_SQL = (
    f"select * exclude (new), cast(sum(new) over (partition by match_id order by event_index rows unbounded preceding) as bigint) as possession_id from "
    f"(select *, row_number() over ({_MATCH}) as event_index, coalesce(cast(ts - lag(ts) over ({_MATCH}) > interval '12 hours' as int), 1) as new from ({EVENTS_SQL}))"
)
_P = "partition by match_id, possession_id order by event_index"
STATES_SQL = (
    f"select *, row_number() over ({_P}) as action_number, count(*) over (partition by match_id, possession_id) as actions, coalesce(lag(event_type) over ({_P}), 'Possession Start') as previous_type, "
    f"(epoch_us(ts) - epoch_us(first_value(ts) over ({_P} rows between unbounded preceding and unbounded following)))/1000000.0 as elapsed_s, sum(xg) over ({_P} rows between current row and unbounded following) as remaining_xg, "
    f"sum(xg) over ({_P} rows between current row and 4 following) as next_5_xg, sum(xg) over ({_P} rows between current row and 9 following) as next_10_xg from ({POSSESSIONS_SQL})"
)


def possessions(spark, sf_dir):
    return S.with_possessions(views.events(spark, sf_dir))


def states(spark, sf_dir):
    return S.with_state(possessions(spark, sf_dir))


@query("possession_states", f"select event_id, match_id, event_index, possession_id, action_number, actions, previous_type, round(elapsed_s::double, 3) as elapsed_s from ({STATES_SQL})")
def possession_states(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.select("event_id", "match_id", F.col("event_index").cast("bigint").alias("event_index"), F.col("possession_id").cast("bigint").alias("possession_id"), F.col("action_number").cast("bigint").alias("action_number"), "actions", "previous_type", F.round("elapsed_s", 3).alias("elapsed_s"))


@query("future_targets", f"select event_id, round(remaining_xg, 6) as remaining_xg from ({STATES_SQL})")
def future_targets(spark, sf_dir):
    return states(spark, sf_dir).select("event_id", F.round("remaining_xg", 6).alias("remaining_xg"))


@query("rolling_horizons", f"select event_id, round(next_5_xg, 6) as next_5_xg, round(next_10_xg, 6) as next_10_xg from ({STATES_SQL})")
def rolling_horizons(spark, sf_dir):
    return states(spark, sf_dir).select("event_id", F.round("next_5_xg", 6).alias("next_5_xg"), F.round("next_10_xg", 6).alias("next_10_xg"))


@query("previous_action", f"select previous_type, event_type, count(*) as n from ({STATES_SQL}) group by 1, 2")
def previous_action(spark, sf_dir):
    return states(spark, sf_dir).groupBy("previous_type", "event_type").agg(F.count("*").alias("n"))


@query(
    "score_difference",
    f"select event_id, cast(2*coalesce(sum(is_goal) over (partition by match_id, team_id order by event_index rows between unbounded preceding and 1 preceding), 0) - coalesce(sum(is_goal) over (partition by match_id order by event_index rows between unbounded preceding and 1 preceding), 0) as bigint) as score_difference from ({POSSESSIONS_SQL})",
)
def score_difference(spark, sf_dir):
    return S.with_score(possessions(spark, sf_dir)).select("event_id", F.col("score_difference").cast("bigint").alias("score_difference"))


_NEXT_SQL = f"select *, lead(value) over ({_P}) as next_value, case when lead(value) over ({_P}) is not null and event_type <> 'Dispossessed' then lead(value) over ({_P}) else 0.0 end - value as action_value from ({POSSESSIONS_SQL})"


@query("next_state_value", f"select event_id, round(next_value, 6) as next_value, round(action_value, 6) as action_value from ({_NEXT_SQL})")
def next_state_value(spark, sf_dir):
    return S.with_next_value(possessions(spark, sf_dir), "value").select("event_id", F.round("next_value", 6).alias("next_value"), F.round("action_value", 6).alias("action_value"))


@query("action_values", f"select match_id, event_type, count(*) as n, round(sum(action_value), 6) as total, round(avg(action_value), 6) as mean from ({_NEXT_SQL}) where event_type in ('Pass', 'Carry') group by 1, 2")
def action_values(spark, sf_dir):
    valued = S.with_next_value(possessions(spark, sf_dir), "value").where(F.col("event_type").isin("Pass", "Carry"))
    return valued.groupBy("match_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("action_value"), 6).alias("total"), F.round(F.avg("action_value"), 6).alias("mean"))


@query(
    "transition_audit",
    f"select event_type, next_type, count(*) as n, round(avg(pause), 3) as mean_pause_s from (select event_type, lead(event_type) over ({_P}) as next_type, (epoch_us(lead(ts) over ({_P})) - epoch_us(ts))/1000000.0 as pause from ({POSSESSIONS_SQL})) where next_type is not null group by 1, 2",
)
def transition_audit(spark, sf_dir):
    return S.transitions(possessions(spark, sf_dir))


@query(
    "context_audit",
    f"select actions, count(*) as events, count(*) filter (action_number = actions) as possessions, count(*) filter (previous_type = event_type) as repeats from ({STATES_SQL}) group by 1",
)
def context_audit(spark, sf_dir):
    return states(spark, sf_dir).groupBy("actions").agg(F.count("*").alias("events"), P.total(F.col("action_number") == F.col("actions")).alias("possessions"), P.total(F.col("previous_type") == F.col("event_type")).alias("repeats"))


@query("pass_ordinals", f"select event_id, row_number() over (partition by match_id order by event_index) - 1 as pass_ordinal from ({POSSESSIONS_SQL}) where event_type = 'Pass'")
def pass_ordinals(spark, sf_dir):
    from pyspark.sql import Window

    passes = possessions(spark, sf_dir).where("event_type = 'Pass'")
    return passes.select("event_id", (F.row_number().over(Window.partitionBy("match_id").orderBy("event_index")) - 1).cast("bigint").alias("pass_ordinal"))


@query(
    "percentiles",
    f"with s as ({style_sql('player_id, position_group')}), l as (unpivot (select player_id, position_group, {', '.join(P.STYLE)} from s) on {', '.join(P.STYLE)} into name metric value value), "
    "r as (select *, rank() over (partition by position_group, metric order by value) + (count(*) over (partition by position_group, metric, value) - 1)/2.0 as r, count(*) over (partition by position_group, metric) as n from l) "
    "select player_id, position_group, metric, value, round(case when n >= 10 then 100.0*(r-1)/(n-1) end, 6)::double as percentile from r",
)
def percentiles(spark, sf_dir):
    return S.percentiles(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), ["player_id"], "position_group", P.STYLE)


_Z = ", ".join(f"round(({f} - avg({f}) over w)/nullif(stddev_pop({f}) over w, 0), 6) as z_{f}" for f in P.STYLE)


@query("zscore_by_group", f"with s as ({style_sql('player_id, position_group')}) select player_id, {_Z} from s window w as (partition by position_group)")
def zscore_by_group(spark, sf_dir):
    z = S.zscores(P.style_profile(features(spark, sf_dir), ["player_id", "position_group"]), "position_group", P.STYLE)
    return z.select("player_id", *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in P.STYLE])


_PM = f"select player_id, match_id, count(*) as n, count(*) filter (progressive) as progressive, sum(completed) as completed from ({FEATURES_SQL}) group by 1, 2"
HALVES_SQL = f"select *, case when row_number() over (partition by player_id order by match_id) - 1 < floor(count(*) over (partition by player_id)/2) then 'first' else 'second' end as half from ({_PM})"


def _halves(spark, sf_dir):
    per = features(spark, sf_dir).groupBy("player_id", "match_id").agg(F.count("*").alias("n"), P.total(F.col("progressive")).alias("progressive"), F.sum("completed").alias("completed"))
    return S.halves(per)


@query("player_halves", f"select player_id, half, count(*) as matches, cast(sum(n) as bigint) as actions from ({HALVES_SQL}) group by 1, 2")
def player_halves(spark, sf_dir):
    return _halves(spark, sf_dir).groupBy("player_id", "half").agg(F.count("*").alias("matches"), F.sum("n").alias("actions"))


@query(
    "split_half_stability",
    f"with h as (select player_id, half, sum(progressive)/sum(n)::double as p, sum(completed)/sum(n)::double as c from ({HALVES_SQL}) group by 1, 2), w as (select player_id, max(p) filter (half = 'first') as p1, max(p) filter (half = 'second') as p2, max(c) filter (half = 'first') as c1, max(c) filter (half = 'second') as c2 from h group by 1) "
    "select count(*) as players, round(corr(p1, p2), 6) as progressive_r, round(corr(c1, c2), 6) as completion_r, round(median(abs(p1 - p2)), 6) as progressive_gap from w",
)
def split_half_stability(spark, sf_dir):
    h = _halves(spark, sf_dir).groupBy("player_id", "half").agg((F.sum("progressive") / F.sum("n")).alias("p"), (F.sum("completed") / F.sum("n")).alias("c"))
    wide = h.groupBy("player_id").pivot("half", ["first", "second"]).agg(F.first("p").alias("p"), F.first("c").alias("c"))
    return wide.agg(F.count("*").alias("players"), F.round(F.corr("first_p", "second_p"), 6).alias("progressive_r"), F.round(F.corr("first_c", "second_c"), 6).alias("completion_r"), F.round(F.median(F.abs(F.col("first_p") - F.col("second_p"))), 6).alias("progressive_gap"))


@query("latest_order", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1")
def latest_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return S.first_rows(orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).drop("o_orderdate")
