"""Registered queries on the stability of neighbours over halves and 100 resamples, the choice of a method, support, fall-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import cells
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.operators import stability as N
from touchline.plans.base import query
from touchline.plans.profiles import FEATURES_SQL, features
from touchline.plans.sequences import HALVES_SQL, _halves
from touchline.plans.vectors import _COS, _MAN, _RMS, STYLE_VECTORS_SQL, style_vectors
from touchline.sources.scratch import stored

RESAMPLES = 100

# Style rates of any subset of matches, from sums per player and match ------------------------------------------------------

_SUMS_SQL = (
    "select player_id, position_group, match_id, count(*) as actions, count(*) filter (action_type = 'Pass') as passes, coalesce(sum(expected_completion) filter (action_type = 'Pass'), 0) as expected, count(*) filter (action_type = 'Pass' and under_pressure) as pressure, "
    f"count(*) filter (action_type = 'Pass' and progressive) as progressive, count(*) filter (action_type = 'Pass' and pass_length >= 30) as long, coalesce(sum(forward_distance) filter (action_type = 'Pass' and forward_distance > 0), 0) as forward from ({FEATURES_SQL}) group by 1, 2, 3"
)
_RATES = ["sum(expected)/sum(passes)", "sum(pressure)/sum(passes)::double", "sum(progressive)/sum(passes)::double", "sum(long)/sum(passes)::double", "100.0*sum(forward)/sum(passes)", "(sum(actions) - sum(passes))/sum(actions)::double"]
_F = [f"f{i}" for i in range(6)]


def _rates_sql(run: str, source: str) -> str:
    """(run, player_id, position_group, v): standardised within run and group."""
    z = "list_value(" + ", ".join(f"coalesce(({f} - avg({f}) over w)/nullif(stddev_pop({f}) over w, 0), 0)" for f in _F) + ")"
    return f"select {run}, player_id, position_group, {z} as v from (select {run}, player_id, position_group, {', '.join(f'{r} as {f}' for r, f in zip(_RATES, _F, strict=True))} from {source} group by 1, 2, 3 having sum(passes) > 0) window w as (partition by {run}, position_group)"


def _sums(spark, sf_dir):
    """A row per eligible player and match."""
    f, kept = features(spark, sf_dir), style_vectors(spark, sf_dir).select("player_id")
    a_pass = F.col("action_type") == "Pass"
    forward = F.sum(F.when(a_pass & (F.col("forward_distance") > 0), F.col("forward_distance")).otherwise(0.0))
    per = f.groupBy("player_id", "position_group", "match_id").agg(
        F.count("*").alias("actions"), P.total(a_pass).alias("passes"), F.sum(F.when(a_pass, F.col("expected_completion")).otherwise(0.0)).alias("expected"), P.total(a_pass & F.col("under_pressure")).alias("pressure"), P.total(a_pass & F.col("progressive")).alias("progressive"), P.total(a_pass & (F.col("pass_length") >= 30)).alias("long"), forward.alias("forward"),
    )
    return stored(per.join(kept, "player_id", "left_semi"), "style-sums")


def _vectors(sums, run: str):
    """(run, player_id, position_group, v)."""
    t = {c: F.sum(c) for c in ("actions", "passes", "expected", "pressure", "progressive", "long", "forward")}
    rates = [t["expected"] / t["passes"], t["pressure"] / t["passes"], t["progressive"] / t["passes"], t["long"] / t["passes"], 100.0 * t["forward"] / t["passes"], (t["actions"] - t["passes"]) / t["actions"]]
    found = sums.groupBy(run, "player_id", "position_group").agg(t["passes"].alias("n"), *[r.alias(f) for r, f in zip(rates, _F, strict=True)]).where("n > 0")
    w = Window.partitionBy(run, "position_group")
    z = [F.coalesce(F.try_divide(F.col(f) - F.avg(f).over(w), F.stddev_pop(f).over(w)), F.lit(0.0)) for f in _F]
    return found.select(run, "player_id", "position_group", F.array(*z).alias("v"))


def _resampled(sums, n: int):
    """By player, so that the rates of all resamples need no shuffle of their many rows."""
    tasks = max(cells.CELLS, int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sums.repartition(tasks, "player_id").join(F.broadcast(X.resamples(sums, "match_id", n, round_up=True)), "match_id")  # a row per match and resample


_BASE = f"s0 as ({STYLE_VECTORS_SQL}), u as materialized (select u.* from ({_SUMS_SQL}) u where player_id in (select player_id from s0))"
_DRAWN = "g as (select distinct match_id from u), r as (select match_id, resample::integer as resample from (select match_id, resample, row_number() over (partition by resample order by md5(resample || ':' || match_id), match_id) as r, count(*) over (partition by resample) as n from g, (select unnest(range({n})) as resample)) where r <= ceil(n*0.8))"


def _near_sql(run: str, vectors: str, distance: str = _RMS, extra: str = "") -> str:
    """The eleven nearest in each run and group."""
    return f"select * from (select a.{run}, {extra} a.player_id as left_id, b.player_id as right_id, row_number() over (partition by a.{run}, {extra.replace(' as method', '')} a.player_id order by round({distance}, 9), b.player_id) as rank from {vectors} a join {vectors} b on a.{run} = b.{run} and a.position_group = b.position_group and a.player_id <> b.player_id) where rank <= {N.KEPT}"


def _compared_sql(x: str, y: str, runs: str, on: str) -> str:
    tops = ", ".join(f"count(*) filter (x <= {k} and y <= {k}) as c{k}" for k in N.TOP)
    shares = ", ".join(f"case when candidates > {k} then coalesce(c{k}, 0)/{k}.0 end as top_{k}_overlap, case when candidates > {k} then coalesce(c{k}, 0)/(2*{k} - coalesce(c{k}, 0))::double end as top_{k}_jaccard" for k in N.TOP)
    return (
        f"(with nx as (select {on} left_id, count(*) as n from {x} group by all), ny as (select {runs}, left_id, count(*) as m from {y} group by all), b as (select ny.*, least(n, m) as candidates from ny join nx using ({on} left_id)), "
        f"c as (select y.*, x.rank as x, y.rank as y from {y} y join {x} x using ({on} left_id, right_id)), e as (select *, row_number() over (partition by {runs}, left_id order by x) as rx, row_number() over (partition by {runs}, left_id order by y) as ry from c), "
        f"m as (select {runs}, left_id, count(*) as c, sum((rx - ry)*(rx - ry)) as d, {tops} from e group by all) select b.*, {shares}, case when c >= 3 then 1 - 6*d/(c*(c*c - 1.0)) end as rank_spearman from b left join m using ({runs}, left_id))"
    )


_MEANS = ", ".join(f"avg({m}) as {m}" for m in N.MEASURES)
_RESAMPLE_SQL = (
    f"with {_BASE}, {_DRAWN.format(n=RESAMPLES)}, fv as materialized ({_rates_sql('whole', '(select 0 as whole, * from u)')}), rv as materialized ({_rates_sql('resample', '(select u.*, resample from u join r on u.match_id = r.match_id)')}), "
    f"fn as materialized (select left_id, right_id, rank from ({_near_sql('whole', 'fv')})), rn as materialized ({_near_sql('resample', 'rv')}), k as materialized {_compared_sql('fn', 'rn', 'resample', '')}, p as materialized (select k.left_id, any_value(fv.position_group) as position_group, count(distinct resample) as runs, {_MEANS} from k join fv on k.left_id = fv.player_id group by 1) "
)


def _resample_means(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    whole = _vectors(sums.withColumn("whole", F.lit(0)), "whole")
    full = cells.nearest_lists(whole, "player_id", ["position_group"], "v", N.KEPT)
    vectors = stored(_vectors(_resampled(sums, RESAMPLES), "resample"), "resample-vectors")
    near = cells.nearest_lists(vectors, "player_id", ["resample", "position_group"], "v", N.KEPT)
    each = N.compared_lists(full.withColumnRenamed("position_group", "group"), near, ["resample", "group"])
    return N.player_means(each, "resample", ["group"]).withColumnRenamed("group", "position_group"), sums


@query("resample_neighbour_stability", _RESAMPLE_SQL + "select left_id as player_id, position_group, runs, " + ", ".join(f"round({m}, 6) as {m}" for m in N.MEASURES) + " from p")
def resample_neighbour_stability(spark, sf_dir):
    """How much of a player's nearest stays in resamples of four fifths of the matches."""
    means, _ = _resample_means(spark, sf_dir)
    return means.select(F.col("left_id").alias("player_id"), "position_group", "runs", *[F.round(m, 6).alias(m) for m in N.MEASURES])


@query(
    "neighbour_stability_summary",
    _RESAMPLE_SQL + f", l as (unpivot (select position_group, {', '.join(N.MEASURES)} from p) on {', '.join(N.MEASURES)} into name measure value x), e as (select * from l union all select 'ALL', measure, x from l) select position_group, measure, count(*) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.25), 6) as p25 from e group by 1, 2",
)
def neighbour_stability_summary(spark, sf_dir):
    means, _ = _resample_means(spark, sf_dir)
    found = N.summarised(means, "position_group")
    return found.select("position_group", "measure", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p25")])


_HALF = f"hv as materialized ({_rates_sql('half', f'(select u.*, h.half from u join ({HALVES_SQL}) h on u.player_id = h.player_id and u.match_id = h.match_id)')}), hn as materialized ({_near_sql('half', 'hv')}), h1 as (select left_id, right_id, rank from hn where half = 'first'), h2 as (select 0 as run, left_id, right_id, rank from hn where half = 'second'), hk as materialized {_compared_sql('h1', 'h2', 'run', '')} "
_THRESHOLDS = [2, 10, 20, 30, 33, 34, 35]


@query(
    "support_stability",
    _RESAMPLE_SQL.rstrip() + f", {_HALF}, q as (select player_id, count(distinct match_id) as matches from u group by 1), a as (select 'resample' as kind, left_id, top_6_overlap from p union all select 'half', left_id, top_6_overlap from hk), t as (select unnest({_THRESHOLDS}) as threshold), c as (select threshold, count(*) as players, avg(matches) as mean_support from t join q on matches >= threshold group by 1), "
    "f as (select threshold, kind, count(*) as measurable, avg(top_6_overlap) as mean_overlap, median(top_6_overlap) as median_overlap from t join q on matches >= threshold join a on a.left_id = q.player_id where top_6_overlap is not null group by 1, 2) "
    "select t.threshold::integer as threshold, k.kind, coalesce(players, 0) as players, round(mean_support, 6) as mean_support, coalesce(measurable, 0) as measurable, round(mean_overlap, 6) as mean_overlap, round(median_overlap, 6) as median_overlap, coalesce(players, 0) >= 20 as meaningful from t cross join (values ('half'), ('resample')) k(kind) left join c on c.threshold = t.threshold left join f on f.threshold = t.threshold and f.kind = k.kind",
)
def support_stability(spark, sf_dir):
    """Stability of players with at least so many matches, over halves and resamples."""
    means, sums = _resample_means(spark, sf_dir)
    halves = _vectors(sums.join(_halves(spark, sf_dir).select("player_id", "match_id", "half"), ["player_id", "match_id"]), "half")
    near = stored(cells.nearest_lists(halves, "player_id", ["half", "position_group"], "v", N.KEPT).select("half", "left_id", "near"), "half-neighbours")
    split = N.compared_lists(near.where("half = 'first'").drop("half"), near.where("half = 'second'"), [])
    both = stored(means.select(F.lit("resample").alias("kind"), "left_id", "top_6_overlap").unionAll(split.select(F.lit("half"), "left_id", "top_6_overlap")), "both-kinds")
    players = sums.groupBy("player_id").agg(F.countDistinct("match_id").alias("matches"))
    found = N.by_support(players, both, "player_id", "matches", _THRESHOLDS)
    return found.select("threshold", "kind", "players", F.round("mean_support", 6).alias("mean_support"), "measurable", F.round("mean_overlap", 6).alias("mean_overlap"), F.round("median_overlap", 6).alias("median_overlap"), "meaningful")


# Choice of a method ------------------------------------------------------------------------------------------------------

_SETS = {"all_6": 6, "first_4": 4}
_FEW = 10
_LONG = "select {run}, player_id, position_group, s.name as feature_set, v[1:s.n] as v from {v}, (values ('all_6', 6), ('first_4', 4)) s(name, n)"
_METHODS = {"rms": _RMS.replace("/6)", "/len(a.v))").replace("range(1, 7)", "range(1, len(a.v) + 1)"), "manhattan": _MAN.replace("/6", "/len(a.v)").replace("range(1, 7)", "range(1, len(a.v) + 1)"), "cosine": _COS}


def _methods_sql(run: str, vectors: str) -> str:
    parts = []
    for name, distance in _METHODS.items():
        parts.append(f"select * from (select a.{run}, a.feature_set, '{name}' as method, a.player_id as left_id, b.player_id as right_id, row_number() over (partition by a.{run}, a.feature_set, a.player_id order by round({distance}, 9), b.player_id) as rank from {vectors} a join {vectors} b on a.{run} = b.{run} and a.feature_set = b.feature_set and a.position_group = b.position_group and a.player_id <> b.player_id) where rank <= {N.KEPT}")
    return " union all ".join(parts)


@query(
    "method_choice",
    f"with {_BASE}, {_DRAWN.format(n=_FEW)}, fv as ({_rates_sql('whole', '(select 0 as whole, * from u)')}), rv as ({_rates_sql('resample', '(select u.*, resample from u join r on u.match_id = r.match_id)')}), hv as ({_rates_sql('half', f'(select u.*, h.half from u join ({HALVES_SQL}) h on u.player_id = h.player_id and u.match_id = h.match_id)')}), "
    f"fl as materialized ({_LONG.format(run='whole', v='fv')}), rl as materialized ({_LONG.format(run='resample', v='rv')}), hl as materialized ({_LONG.format(run='half', v='hv')}), fn as materialized (select feature_set, method, left_id, right_id, rank from ({_methods_sql('whole', 'fl')})), rn as materialized ({_methods_sql('resample', 'rl')}), hn as materialized ({_methods_sql('half', 'hl')}), "
    "h1 as (select feature_set, method, left_id, right_id, rank from hn where half = 'first'), h2 as (select feature_set, method, left_id, right_id, rank from hn where half = 'second'), "
    f"rk as {_compared_sql('fn', 'rn', 'resample, feature_set, method', 'feature_set, method,')}, hk as {_compared_sql('h1', 'h2', 'feature_set, method', 'feature_set, method,')}, "
    "rp as (select feature_set, method, left_id, avg(top_6_overlap) as o from rk group by 1, 2, 3), x as (select feature_set, method, avg(o) as resample_mean from rp group by 1, 2), y as (select feature_set, method, avg(top_6_overlap) as split_mean, median(top_6_overlap) as split_median, avg(rank_spearman) as split_spearman from hk group by 1, 2), "
    "z as (select *, case feature_set when 'all_6' then 6 else 4 end as feature_count, (split_mean + resample_mean)/2 as score from x join y using (feature_set, method)), b as (select *, max(score) over () as best_score from z) "
    "select feature_set, feature_count::integer as feature_count, method, round(score, 6) as score, round(best_score, 6) as best_score, round(split_mean, 6) as split_mean, round(split_median, 6) as split_median, round(split_spearman, 6) as split_spearman, round(resample_mean, 6) as resample_mean, split_mean >= 0.35 and split_median >= 1/3.0 and split_spearman >= 0.25 and resample_mean >= 0.6 as defensible "
    "from b where best_score - score <= 0.01 + 1e-12 order by feature_count, list_position(['rms', 'manhattan', 'cosine'], method), score desc, feature_set limit 1",
)
def method_choice(spark, sf_dir):
    """Three distances on two sets of features: the simplest of those about as stable as the best."""
    sums = _sums(spark, sf_dir)
    halves = sums.join(_halves(spark, sf_dir).select("player_id", "match_id", "half"), ["player_id", "match_id"])
    sets = F.explode(F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(n).alias("n")) for s, n in _SETS.items()]))

    def lists(vectors, runs, name):
        long = stored(vectors.withColumn("s", sets).select(*runs, "player_id", "position_group", "s.feature_set", F.slice("v", 1, F.col("s.n")).alias("v")), "method-rows")
        near = [N.neighbours(long, "player_id", [*runs, "feature_set", "position_group"], metric=m).withColumn("method", F.lit(m)) for m in N.PRIORITY]
        return stored(reduce(DataFrame.unionByName, near).select(*runs, "feature_set", "method", "left_id", "right_id", "rank"), name)

    full = lists(_vectors(sums.withColumn("whole", F.lit(0)), "whole").drop("whole"), [], "full-methods")
    near, half = lists(_vectors(_resampled(sums, _FEW), "resample"), ["resample"], "resample-methods"), lists(_vectors(halves, "half"), ["half"], "half-methods")
    kinds = ["feature_set", "method"]
    resampled = N.player_means(N.compared(full, near, ["resample", *kinds]), "resample", kinds).groupBy(*kinds).agg(F.avg("top_6_overlap").alias("resample_mean"))
    split = N.compared(half.where("half = 'first'").drop("half"), half.where("half = 'second'").drop("half"), kinds)
    split = split.groupBy(*kinds).agg(F.avg("top_6_overlap").alias("split_mean"), F.percentile("top_6_overlap", 0.5).alias("split_median"), F.avg("rank_spearman").alias("split_spearman"))
    results = resampled.join(split, kinds).withColumn("feature_count", F.when(F.col("feature_set") == "all_6", 6).otherwise(4))
    found = N.chosen_method(results)
    return found.select("feature_set", "feature_count", "method", *[F.round(c, 6).alias(c) for c in ("score", "best_score", "split_mean", "split_median", "split_spearman", "resample_mean")], "defensible")


# Fall-back ---------------------------------------------------------------------------------------------------------------


@query(
    "neighbours_with_fallback",
    f"with s as (select player_id, team_id % 5 as cohort, position_group, v from ({STYLE_VECTORS_SQL})), n as (select cohort, position_group, count(*) - 1 as others from s group by 1, 2), q as (select s.*, others < 5 as fell_back from s join n using (cohort, position_group)), "
    f"d as (select a.cohort, a.player_id as left_id, b.player_id as right_id, b.position_group as right_group, a.fell_back, {_RMS} as distance from q a join s b on a.cohort = b.cohort and a.player_id <> b.player_id and (a.position_group = b.position_group or (a.fell_back and (a.position_group = 'MID' or b.position_group = 'MID')))) "
    "select cohort, left_id, right_id, right_group, fell_back, round(distance, 6) as distance, rank::integer as rank from (select *, row_number() over (partition by cohort, left_id order by round(distance, 9), right_id) as rank from d) where rank <= 10",
)
def neighbours_with_fallback(spark, sf_dir):
    """Nearest players of the same group of teams; groups of fewer than six look at adjacent positions too."""
    s = style_vectors(spark, sf_dir).select("player_id", (F.col("team_id") % 5).alias("cohort"), "position_group", "v")
    found = N.neighbours_with_fallback(s, "player_id", "cohort", "position_group")
    return found.select("cohort", "left_id", "right_id", "right_group", "fell_back", F.round("distance", 6).alias("distance"), "rank")
