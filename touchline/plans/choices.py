"""Registered queries on choices of models and splits, comparison of values, runs and their calls, subsets, context by match."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import model_choice as M
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.operators import sequences as S
from touchline.operators import traces as T
from touchline.operators.ordering import spearman
from touchline.plans.base import query
from touchline.plans.profiles import FEATURES_SQL, features, style_sql
from touchline.plans.sequences import HALVES_SQL, POSSESSIONS_SQL, STATES_SQL, _halves, possessions, states
from touchline.session import table
from touchline.sources import views
from touchline.sources.scratch import in_parts, stored
from touchline.sources.views import PASSES_SQL

_SPLIT = f"select match_id, case when r <= floor(0.8*n) then 'train' when r <= floor(0.9*n) then 'validation' else 'test' end as part from (select match_id, row_number() over (order by md5(match_id::varchar), match_id) as r, count(*) over () as n from (select distinct match_id from ({PASSES_SQL})))"
_CANDIDATES = {"as_given": "p", "shrunk": "0.66 + (p - 0.7)/4", "constant": "0.7", "level": "0.7"}
_CLIP = "greatest(1e-7, least(1 - 1e-7, {p}))"


@query(
    "model_by_validation",
    f"with d as (select completed as y, expected_completion as p from ({PASSES_SQL}) x join ({_SPLIT}) s on x.match_id = s.match_id where part = 'validation'), c as (" + " union all ".join(f"select '{n}' as model, y, {e} as p from d" for n, e in _CANDIDATES.items()) + "), "
    f"s as (select model, count(*) as n, avg(-case when y = 1 then ln({_CLIP.format(p='p')}) else ln(1 - {_CLIP.format(p='p')}) end) as log_loss, avg((p - y)*(p - y)) as brier from c group by 1) select model, n, round(log_loss, 6) as log_loss, round(brier, 6) as brier, row_number() over (order by round(log_loss, 9), round(brier, 9), model) = 1 as chosen from s",
)
def model_by_validation(spark, sf_dir):
    """Candidates scored on the validation part; two of them tie, so that the name decides between these."""
    rows = views.actions(spark, sf_dir).select("match_id", F.col("completed").alias("y"), F.col("expected_completion").alias("p"))
    held = rows.join(X.three_way_split(rows, "match_id"), "match_id").where("part = 'validation'")
    s = M.scored_candidates(held, "y", {n: F.expr(e) for n, e in _CANDIDATES.items()})
    return s.select("model", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"), "chosen")


@query("gain_importance")
def gain_importance(spark, sf_dir):
    """Share of each number in a boosted model's gain."""
    names = ["pass_length", "forward_distance", "start_goal_distance", "expected_completion"]
    rows = features(spark, sf_dir).select(F.col("completed").cast("double").alias("y"), *names)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=42)]).fit(in_parts(rows, "gain-rows"))
    found = M.importances(names, [float(v) for v in fitted.stages[-1].featureImportances.toArray()])
    return spark.createDataFrame(found, "feature string, share double")


_FOLDS5 = f"select match_id, ((row_number() over (order by md5(match_id::varchar), match_id) - 1) % 5 + 1)::integer as fold from (select distinct match_id from ({PASSES_SQL}))"


@query(
    "calibration_parts",
    f"with f as ({_FOLDS5}), e as (select f.match_id, o.outer_fold, f.fold = o.outer_fold as held from f, (select distinct fold as outer_fold from f) o), r as (select *, row_number() over (partition by outer_fold, held order by md5(outer_fold || ':' || match_id), match_id) as r, count(*) over (partition by outer_fold, held) as n from e) "
    "select outer_fold, match_id, case when held then 'held_out' when r <= greatest(floor(n*0.1), 1) then 'calibration' else 'fit' end as part from r",
)
def calibration_parts(spark, sf_dir):
    """Inside each outer fold a tenth of its training matches is kept for calibration."""
    return M.calibration_parts(X.folds(views.actions(spark, sf_dir), "match_id", 5), "match_id")


@query("frozen_split", f"select part, count(distinct x.match_id) as matches, count(*) as n, round(avg(completed), 6) as completed from ({PASSES_SQL}) x join ({_SPLIT}) s on x.match_id = s.match_id group by 1")
def frozen_split(spark, sf_dir):
    """A stored split used again; it must cover exactly the matches at hand."""
    rows = views.actions(spark, sf_dir).select("match_id", "completed")
    found = M.with_frozen_split(rows, stored(X.three_way_split(rows, "match_id"), "frozen-split"), "match_id")
    return found.groupBy("part").agg(F.countDistinct("match_id").alias("matches"), F.count("*").alias("n"), F.round(F.avg("completed"), 6).alias("completed"))


_TWO = f"select event_id, event_type, next_5_xg - xg as a, (next_10_xg - xg)*0.9 - 0.005 as b from ({STATES_SQL})"


def _two(spark, sf_dir):
    return states(spark, sf_dir).select("event_id", "event_type", (F.col("next_5_xg") - F.col("xg")).alias("a"), ((F.col("next_10_xg") - F.col("xg")) * 0.9 - 0.005).alias("b"))


@query("impact_comparison", f"select event_type, count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(abs(a - b)), 6) as mean_gap, round(corr(a, b), 5) as pearson, round(avg((sign(a) = sign(b))::int), 6) as same_sign from ({_TWO}) group by 1")
def impact_comparison(spark, sf_dir):
    c = M.impact_comparison(_two(spark, sf_dir), "event_type", "a", "b")
    return c.select("event_type", "n", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "mean_gap")], F.round("pearson", 5).alias("pearson"), F.round("same_sign", 6).alias("same_sign"))


@query("largest_disagreements", f"select event_id, event_type, round(a, 6) as a, round(b, 6) as b, row_number() over (order by round(abs(a - b), 9) desc, event_id)::integer as rank from ({_TWO}) qualify rank <= 20")
def largest_disagreements(spark, sf_dir):
    return M.largest_disagreements(_two(spark, sf_dir), "event_id", "a", "b").select("event_id", "event_type", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "rank")


# Runs and calls ----------------------------------------------------------------------------------------------------------

_RUNS = "select conv_id, case when count(*) % 5 = 0 then 'failed' when count(*) % 2 = 0 then 'complete' else 'partial' end as status, sum(length(text)) as latency, case when {priced} then sum(turn)*0.001::double end as cost from conversations group by 1"


@query(
    "run_overview",
    " union all ".join(
        f"select '{name}' as cohort, count(*) as runs, " + ", ".join(f"count(*) filter (status = '{s}') as {s}, round(avg((status = '{s}')::int), 6) as {s}_rate" for s in ("complete", "partial", "failed"))
        + f", round(avg(latency), 4) as mean_latency, round(case when count(cost) = count(*) then sum(cost) end, 6) as total_cost, count(cost) as priced, quantile_disc(latency, 0.5)::bigint as p50_latency, quantile_disc(latency, 0.95)::bigint as p95_latency from ({_RUNS.format(priced=priced)})"
        for name, priced in (("all", "conv_id % 7 > 0"), ("priced", "true"))
    ),
)
def run_overview(spark, sf_dir):
    """Conversations as runs, once with and once without missing prices."""
    n = F.count("*")
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(n % 5 == 0, "failed").when(n % 2 == 0, "complete").otherwise("partial").alias("status"), F.sum(F.length("text")).alias("latency"), (F.sum("turn") * 0.001).alias("full_cost"))
    parts = []
    for name, cost in (("all", F.when(F.col("conv_id") % 7 > 0, F.col("full_cost"))), ("priced", F.col("full_cost"))):
        o = T.run_overview(runs.withColumn("cost", cost), ["complete", "partial", "failed"])
        rates = [F.round(f"{s}_rate", 6).alias(f"{s}_rate") for s in ("complete", "partial", "failed")]
        parts.append(o.select(F.lit(name).alias("cohort"), "runs", "complete", "partial", "failed", *rates, F.round("mean_latency", 4).alias("mean_latency"), F.round("total_cost", 6).alias("total_cost"), "priced", "p50_latency", "p95_latency"))
    return parts[0].unionByName(parts[1])


@query("tool_frequency", "select role as tool, count(*) as calls, count(distinct conv_id) as runs, round(count(*)/sum(count(*)) over ()::double, 6) as share from conversations group by 1")
def tool_frequency(spark, sf_dir):
    f = T.tool_frequency(table(spark, sf_dir, "conversations"), "conv_id", "role")
    return f.select(F.col("role").alias("tool"), "calls", "runs", F.round("share", 6).alias("share"))


@query(
    "first_calls",
    "with c as (select event_id, user_id, event_type, cast(json_extract(props, '$.k') as bigint) % 4 as k from events) select event_id, user_id as run_id, event_type as tool, '{\"a\":' || k || ',\"b\":{\"x\":true,\"y\":[1,\"2\"]}}' as arguments, (count(*) over (partition by user_id, event_type, k) - 1) as repeats from c qualify row_number() over (partition by user_id, event_type, k order by event_id) = 1",
)
def first_calls(spark, sf_dir):
    """Calls whose arguments are spelled in three ways; those that say the same are one."""
    k = (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")
    ways = [('{"a": ', ', "b": {"x": true, "y": [1, "2"]}}'), ('{"b":{"y":[1,"2"],"x":true},"a":', "}"), ('{ "b" : {"x":true ,"y":[ 1,"2"]} , "a":\n', " }")]
    spelled = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(ways[0][0]), k, F.lit(ways[0][1]))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(ways[1][0]), k, F.lit(ways[1][1]))).otherwise(F.concat(F.lit(ways[2][0]), k, F.lit(ways[2][1])))
    calls = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"), spelled.alias("raw"))
    return T.first_calls(calls, "run_id", "tool", "raw", "event_id").select("event_id", "run_id", "tool", F.col("arguments_canonical").alias("arguments"), "repeats")


_RESULTS = "select page_id, url || case when page_id % 4 = 0 then '/' else '' end as url, ['alpha', 'beta', 'gamma'][1 + page_id % 3] as subject, case when page_id % 5 = 0 then 'About Delta' else 'On ' || upper(['alpha', 'beta', 'gamma'][1 + page_id % 3]) || ' today' end as title, case when page_id % 11 > 0 then page_id % 60 end as age_days, page_id % 3 as quality from pages"
_BEST = "quality desc, age_days asc nulls last, url"


@query(
    "selected_results",
    f"with r as ({_RESULTS}), f as (select *, regexp_replace(url, '/+$', '') as plain_url, lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]+)', 1)) as host from r where contains(lower(title), subject) and coalesce(age_days <= 30, true)), a as (select * from f qualify row_number() over (partition by subject, plain_url order by {_BEST}) = 1), b as (select * from a qualify row_number() over (partition by subject, host order by {_BEST}) = 1) "
    f"select subject, page_id, host, age_days, row_number() over (partition by subject order by {_BEST})::integer as rank from b qualify rank <= 3",
)
def selected_results(spark, sf_dir):
    """Three recent results a subject, each host once."""
    i = F.col("page_id")
    subject = F.get(F.array(*[F.lit(s) for s in ("alpha", "beta", "gamma")]), (i % 3).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(i % 4 == 0, "/").otherwise("")).alias("url"), subject.alias("subject"), F.when(i % 5 == 0, "About Delta").otherwise(F.concat(F.lit("On "), F.upper(subject), F.lit(" today"))).alias("title"), F.when(i % 11 > 0, i % 60).alias("age_days"), (i % 3).alias("quality"))
    return T.selected_results(rows, "subject", 30).select("subject", "page_id", "host", "age_days", "rank")


@query("team_names", f"select distinct team_id, team_name from ({PASSES_SQL})")
def team_names(spark, sf_dir):
    """Names of all teams of passes and shots; two names of one team would raise."""
    return T.names_by_id([views.passes(spark, sf_dir), views.shots(spark, sf_dir)], "team_id", "team_name")


# Subsets and context -----------------------------------------------------------------------------------------------------


@query(
    "subset_profile",
    f"select round(carry_share, 6) as carry_share, passes, carries, matches from ({style_sql('position_group', f'select * from (select f.* replace (case when player_id % 5 = 0 then null else player_id end as player_id) from ({FEATURES_SQL}) f) where team_id in (3, 4, 7) and match_id < 20 and position_group = ' + chr(39) + 'DEF' + chr(39) + ' and player_id is distinct from 48')})",
)
def subset_profile(spark, sf_dir):
    """Some teams' profile in a role over some matches without one player; rows without a player stay."""
    rows = features(spark, sf_dir).withColumn("player_id", F.when(F.col("player_id") % 5 > 0, F.col("player_id")))
    kept = X.subset(rows, teams=[3, 4, 7], matches=list(range(20)), group="DEF", without_player=48)
    p = P.style_profile(kept, ["position_group"])
    return p.select(F.round("carry_share", 6).alias("carry_share"), "passes", "carries", "matches")


@query(
    "match_context",
    f"with c as (select event_id, match_id, event_type, team_id, lag(event_type) over w as before_type, lag(team_id) over w as before_team, lead(event_type) over w as after_type, lead(team_id) over w as after_team from ({POSSESSIONS_SQL}) window w as (partition by match_id order by event_index)) "
    "select event_type, coalesce(before_type, '-') as before_type, coalesce(after_type, '-') as after_type, count(*) as n, count(*) filter (before_team = team_id) as same_before, count(*) filter (after_team = team_id) as same_after, count(*) filter (before_team = after_team and before_team <> team_id) as between_opponents from c group by 1, 2, 3",
)
def match_context(spark, sf_dir):
    """What comes before and after each event of a match, and whose it is."""
    w = Window.partitionBy("match_id").orderBy("event_index")
    c = possessions(spark, sf_dir).select("event_id", "match_id", "event_type", "team_id", *[f("event_type").over(w).alias(f"{n}_type") for f, n in ((F.lag, "before"), (F.lead, "after"))], *[f("team_id").over(w).alias(f"{n}_team") for f, n in ((F.lag, "before"), (F.lead, "after"))])
    count = lambda x: F.count(F.when(x, 1))
    return c.groupBy("event_type", F.coalesce("before_type", F.lit("-")).alias("before_type"), F.coalesce("after_type", F.lit("-")).alias("after_type")).agg(
        F.count("*").alias("n"), count(F.col("before_team") == F.col("team_id")).alias("same_before"), count(F.col("after_team") == F.col("team_id")).alias("same_after"), count((F.col("before_team") == F.col("after_team")) & (F.col("before_team") != F.col("team_id"))).alias("between_opponents")
    )


_WIDE = f"select player_id, max(p) filter (half = 'first') as a, max(p) filter (half = 'second') as b from (select player_id, half, sum(progressive)/sum(n)::double as p from ({HALVES_SQL}) group by 1, 2) group by 1"
_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1)/2.0"


@query("split_half_spearman", f"with w as ({_WIDE}), r as (select {_RANK.format('a')} as ra, {_RANK.format('b')} as rb from w where a is not null and b is not null) select count(*) as players, round(corr(ra, rb), 6) as spearman from r")
def split_half_spearman(spark, sf_dir):
    """Rank correlation of a rate between both halves of the matches."""
    h = _halves(spark, sf_dir).groupBy("player_id", "half").agg((F.sum("progressive") / F.sum("n")).alias("p"))
    wide = stored(h.groupBy("player_id").agg(F.max(F.when(F.col("half") == "first", F.col("p"))).alias("a"), F.max(F.when(F.col("half") == "second", F.col("p"))).alias("b")).where("a is not null and b is not null"), "halves")
    return wide.agg(F.count("*").alias("players")).crossJoin(spearman(wide, "a", "b").select(F.round("spearman", 6).alias("spearman")))  # one row each


_ORDER = ["match_number", "start_x", "end_x", "player_id", "quantity", "attacking_value"]
_CARRIED = ["order_key", "match_id", "team_id", "player_id", "match_number", "action_type"]
_LEADS = ", ".join(f"lead({c}) over w as after_{c}" for c in (*_CARRIED, "start_x", "start_y"))


@query(
    "transition_coordinates",
    f"with t as (select *, {_LEADS}, lead(1) over w as nxt from ({PASSES_SQL}) window w as (partition by order_key order by {', '.join(_ORDER)})), d as (select *, sqrt((end_x - after_start_x)*(end_x - after_start_x) + (end_y - after_start_y)*(end_y - after_start_y)) as d from t where nxt = 1 and completed = 1) "
    "select action_type, count(*) as n, count(*) filter (d <= 1e-9) as exact, count(*) filter (d <= 10) as near, round(median(d), 6) as median, round(quantile_cont(d, 0.95), 6) as p95, round(quantile_cont(d, 0.99), 6) as p99, round(max(d), 6) as most, count(*) filter (after_match_id <> match_id) as other_match, count(*) filter (after_order_key <> order_key) as other_possession, count(*) filter (after_team_id <> team_id) as other_team, count(*) filter (after_match_number < match_number) as backwards, count(*) filter (after_action_type = 'Carry') as carry_after from d group by 1",
)
def transition_coordinates(spark, sf_dir):
    """How far successful actions end from where the next one begins, and whether it is of the same match, possession and team."""
    t = S.transitions_in_space(views.passes(spark, sf_dir), ["order_key"], _ORDER, _CARRIED, ("end_x", "end_y"), ("start_x", "start_y")).where("completed = 1")
    count = lambda c: F.count(F.when(F.expr(c), 1))
    spread = [F.round(F.percentile("discrepancy", p), 6).alias(n) for n, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))]  # over few distinct distances
    return t.groupBy("action_type").agg(
        F.count("*").alias("n"), count("discrepancy <= 1e-9").alias("exact"), count("discrepancy <= 10").alias("near"), *spread, F.round(F.max("discrepancy"), 6).alias("most"), count("after_match_id <> match_id").alias("other_match"),
        count("after_order_key <> order_key").alias("other_possession"), count("after_team_id <> team_id").alias("other_team"), count("after_match_number < match_number").alias("backwards"), count("after_action_type = 'Carry'").alias("carry_after"),
    )
