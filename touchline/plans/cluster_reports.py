"""Registered queries on fitted clusters: centres, names, margins, sensitivity; predictability of positions; decisions on roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import cluster_reports as R
from touchline.operators import clustering as C
from touchline.operators import intelligence as I
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.operators import similarity as V
from touchline.plans.base import query
from touchline.plans.clusters import _REF_SQL, K, RESTARTS, ROUNDS, _lloyd_sql, _reference
from touchline.plans.pages import players
from touchline.plans.profiles import features, style_profile_player, style_sql
from touchline.plans.sequences import HALVES_SQL, _halves
from touchline.plans.stability import _DRAWN, _RATES, _SUMS_SQL
from touchline.plans.vectors import _RMS, DIMS, STYLE_VECTORS_SQL, _role_distances, style_vectors
from touchline.sources.scratch import stored

_NAMES = "[" + ", ".join(f"'{f}'" for f in P.STYLE) + "]"

# Centres -----------------------------------------------------------------------------------------------------------------


@query(
    "cluster_centres",
    _REF_SQL + f", e9 as (select reference, unnest({_NAMES}) as feature, unnest(v) as x, unnest(range(1, {DIMS + 1})) as i from ref), p9 as (select reference, feature, any_value(i) as i, count(*) as size, avg(x) as mean, stddev_pop(x) as std from e9 group by 1, 2) "
    "select reference::integer as cluster, size, feature, round(mean, 6) as mean, round(std, 6) as std, row_number() over (partition by reference order by round(abs(mean), 9) desc, i)::integer as place, row_number() over (partition by reference order by round(abs(mean), 9) desc, i) <= 4 as distinguishing from p9",
)
def cluster_centres(spark, sf_dir):
    t = R.centre_table(_reference(spark, sf_dir), "reference", "v", P.STYLE)
    return t.select(F.col("reference").alias("cluster"), "size", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "place", "distinguishing")


_DC = "sqrt(" + " + ".join(f"(ref.v[{i}] - c9.c[{i}])*(ref.v[{i}] - c9.c[{i}])" for i in range(1, DIMS + 1)) + ")"
_MEANS = "list_value(" + ", ".join(f"avg(v[{i}])" for i in range(1, DIMS + 1)) + ")"


@query(
    "cluster_margins",
    _REF_SQL + f", c9 as (select reference as l, {_MEANS} as c from ref group by 1), d9 as (select player_id, reference, l, {_DC} as d from ref, c9), m9 as (select player_id, reference, max(d) filter (l = reference) as distance, min(d) filter (l <> reference) as second from d9 group by 1, 2) "
    "select player_id, reference::integer as cluster, round(distance, 6) as distance, round(second, 6) as second_distance, round((second - distance)/greatest(second, 1e-12), 6) as margin from m9",
)
def cluster_margins(spark, sf_dir):
    """Fitted archetype of each player with its distance, that to the next centre, and their margin."""
    m = R.margins(_reference(spark, sf_dir), "player_id", "v", "reference")
    return m.select("player_id", F.col("reference").alias("cluster"), *[F.round(c, 6).alias(c) for c in ("distance", "second_distance", "margin")])


_FEW = 5


@query(
    "cluster_sensitivity",
    "with " + _lloyd_sql(_FEW * (DIMS + 1), 0).replace(f"m as (select unnest(range({_FEW * (DIMS + 1)})) as run, player_id, v from s)", f"m as (select run, player_id, list_transform(v, lambda x, i: case when i = run // {_FEW} then 0.0 else x end) as v from s, (select unnest(range({_FEW * (DIMS + 1)})) as run))")
    + f", w as (select run // {_FEW} as f, fit from best qualify row_number() over (partition by run // {_FEW} order by inertia, fit) = 1), l as (select w.f, a.player_id, a.label from a join w on a.fit = w.fit), n as (select l.f, b.label as reference, l.label, count(*) as n from l join l b on b.player_id = l.player_id and b.f = 0 where l.f > 0 group by 1, 2, 3), "
    "x as (select f, sum(n*(n-1)/2) as both_ from n group by 1), y as (select f, sum(n*(n-1)/2) as r, sum(n)*(sum(n)-1)/2 as t from (select f, reference, sum(n) as n from n group by 1, 2) group by 1), z as (select f, sum(n*(n-1)/2) as c from (select f, label, sum(n) as n from n group by 1, 2) group by 1) "
    f"select {_NAMES}[f] as left_out, round((both_ - r*c/t)/((r + c)/2 - r*c/t), 6) as ari from x join y using (f) join z using (f)",
)
def cluster_sensitivity(spark, sf_dir):
    """How far the clusters depend on each single feature."""
    rows = style_vectors(spark, sf_dir).select("player_id", "v")
    return R.sensitivity(rows, "player_id", "v", P.STYLE, K, _FEW, RESTARTS, ROUNDS).select("left_out", F.round("ari", 6).alias("ari"))


# Predictability ----------------------------------------------------------------------------------------------------------

_OUTFIELD = f"select player_id, position_group, {', '.join(P.STYLE)} from ({style_sql('player_id, position_group')}) where position_group <> 'GK'"
_Z2 = " + ".join(f"pow((r.{f} - c.c_{f})/s_{f}, 2)" for f in P.STYLE)


def _outfield(spark, sf_dir):
    return stored(style_profile_player(spark, sf_dir).where("position_group <> 'GK'").select("player_id", "position_group", *P.STYLE), "outfield")


def _report(rows):
    r = R.classification_report(rows, "position_group", "predicted")
    return r.select("rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "majority_baseline")])


@query(
    "position_predictability",
    f"with r as materialized ({_OUTFIELD}), f as (select *, (row_number() over (partition by position_group order by md5(player_id::varchar), player_id) - 1) % 5 + 1 as fold from r), k as (select unnest(range(1, 6)) as k), m as (select k, {', '.join(f'stddev_pop({f}) as s_{f}' for f in P.STYLE)} from f, k where fold <> k group by 1), c as (select k, position_group as l, {', '.join(f'avg({f}) as c_{f}' for f in P.STYLE)} from f, k where fold <> k group by 1, 2), "
    f"d as (select r.player_id, r.position_group as a, c.l as p from f r join c on r.fold = c.k join m on r.fold = m.k qualify row_number() over (partition by r.player_id order by round({_Z2}, 9), c.l) = 1), l as (select a as l from d union select p from d), e as (select l.l, count(*) filter (a = l.l) as actual, count(*) filter (p = l.l) as predicted, count(*) filter (a = l.l and p = l.l) as hit from d, l group by 1) "
    'select sum(actual)::bigint as "rows", round(sum(hit)/sum(actual), 6) as accuracy, round(avg(hit/actual::double) filter (actual > 0), 6) as balanced_accuracy, round(avg(2*hit/(actual + predicted)::double), 6) as macro_f1, round(max(actual)/sum(actual), 6) as majority_baseline from e',
)
def position_predictability(spark, sf_dir):
    """How well nearest means of style tell a position, over stratified folds."""
    return _report(R.predicted_labels(_outfield(spark, sf_dir), "player_id", "position_group", P.STYLE, fit=R.centroid_labels))


@query("position_predictability_logistic")
def position_predictability_logistic(spark, sf_dir):
    return _report(R.predicted_labels(_outfield(spark, sf_dir), "player_id", "position_group", P.STYLE))


# Decisions on roles ------------------------------------------------------------------------------------------------------

_R, _CLUBS = 20, 5
"""Resamples; teams are taken together, so that roles have several players."""
_TEAM_SUMS = _SUMS_SQL.replace("select player_id, position_group, match_id,", f"select team_id % {_CLUBS} as team_id, position_group, match_id, player_id,").replace("group by 1, 2, 3", "group by 1, 2, 3, 4")
_STATS = f"select position_group, {', '.join(f'avg({f}) as m{i}, stddev_pop({f}) as s{i}' for i, f in enumerate(P.STYLE))} from ({style_sql('player_id, position_group')}) where position_group <> 'GK' and passes >= 50 and carries >= 29 group by 1"


def _role_sql(run: str, source: str) -> str:
    z = ", ".join(f"(({r}) - any_value(m{i}))/any_value(s{i})" for i, r in enumerate(_RATES))
    return f"select {run}, team_id, position_group, list_value({z}) as v from {source} join st using (position_group) where position_group <> 'GK' group by 1, 2, 3 having sum(passes) > 0"


_RANK_SQL = "select r.{run}, r.team_id, r.position_group, s.player_id, row_number() over (partition by r.{run}, r.team_id, r.position_group order by round({d}, 9), s.player_id) as rank from {roles} r join s on s.position_group = r.position_group and s.team_id <> r.team_id"
_D_RS = _RMS.replace("a.v", "r.v").replace("b.v", "s.v")
_D_AB = _RMS


@query(
    "role_decisions",
    f"with s as materialized (select player_id, position_group, team_id % {_CLUBS} as team_id, v from ({STYLE_VECTORS_SQL})), st as materialized ({_STATS}), u as materialized ({_TEAM_SUMS}), {_DRAWN.format(n=_R)}, h as (select player_id, match_id, half from ({HALVES_SQL})), "
    f"w as materialized ({_role_sql('whole', '(select 0 as whole, * from u)')}), rr as materialized ({_role_sql('resample', '(select u.*, resample from u join r on u.match_id = r.match_id)')}), hh as materialized ({_role_sql('half', '(select u.*, half from u join h on u.player_id = h.player_id and u.match_id = h.match_id)')}), "
    f"hd as (select a.team_id, a.position_group, {_D_AB} as half_distance from hh a join hh b on a.team_id = b.team_id and a.position_group = b.position_group where a.half = 'first' and b.half = 'second'), rd as (select a.team_id, a.position_group, median({_D_AB}) as median_resample from w a join rr b on a.team_id = b.team_id and a.position_group = b.position_group group by 1, 2), "
    f"wk as materialized ({_RANK_SQL.format(run='whole', d=_D_RS, roles='w')}), rk as materialized ({_RANK_SQL.format(run='resample', d=_D_RS, roles='rr')}), fk as ({_RANK_SQL.format(run='half', d=_D_RS, roles='hh')}), "
    "rt as (select team_id, position_group, median(o) as median_top6 from (select y.resample, y.team_id, y.position_group, count(*) filter (x.rank <= 6 and y.rank <= 6)/6.0 as o from wk x join rk y using (team_id, position_group, player_id) group by 1, 2, 3) group by 1, 2), "
    "ct as (select team_id, position_group, count(*) filter (x.rank <= 6 and y.rank <= 6)/6.0 as candidate_top6, case when count(*) >= 3 then 1 - 6*sum((x.rank - y.rank)*(x.rank - y.rank))/(count(*)*(count(*)*count(*) - 1.0)) end as candidate_spearman from wk x join fk y using (team_id, position_group, player_id) where y.half = 'first' group by 1, 2), "
    "p as (select team_id, position_group, player_id, sum(actions) as n from u group by 1, 2, 3), c as (select team_id, position_group, count(*) as players, max(n)/sum(n)::double >= 0.4 or sum(n) filter (r <= 2)/sum(n)::double >= 0.65 as concentrated from (select *, row_number() over (partition by team_id, position_group order by n desc, player_id) as r from p) group by 1, 2), "
    "j as (select w.team_id, w.position_group, half_distance, median_resample, median_top6, candidate_spearman, candidate_top6, players, concentrated from w join c using (team_id, position_group) left join hd using (team_id, position_group) left join rd using (team_id, position_group) left join rt using (team_id, position_group) left join ct using (team_id, position_group)) "
    f"select team_id, position_group, round(half_distance, 6) as half_distance, round(median_resample, 6) as median_resample, round(median_top6, 6) as median_top6, round(candidate_spearman, 6) as candidate_spearman, round(candidate_top6, 6) as candidate_top6, players, concentrated, case when half_distance <= 1.0 and median_resample <= 0.35 and players >= 3 and not concentrated then '{R.GO}' when median_resample <= 0.5 and players >= 3 then '{R.LIMITED}' else '{R.NO}' end as role_decision, "
    f"case when half_distance <= 1.0 and median_resample <= 0.35 and median_top6 >= 0.67 and candidate_spearman >= 0.7 and candidate_top6 >= 0.67 and players >= 3 and not concentrated then '{R.LIMITED}' else '{R.NO}' end as fit_decision from j",
)
def role_decisions(spark, sf_dir):
    """Whether a team's role is stable enough to show, and its candidates stable enough to rank."""
    roles = stored(_role_evidence(spark, sf_dir), "role-evidence")
    found = R.role_decisions(roles)
    return found.select("team_id", "position_group", *[F.round(c, 6).alias(c) for c in ("half_distance", "median_resample", "median_top6", "candidate_spearman", "candidate_top6")], "players", "concentrated", "role_decision", "fit_decision")


def _role_evidence(spark, sf_dir):
    club = F.col("team_id") % _CLUBS
    f, s = features(spark, sf_dir).withColumn("team_id", club), stored(style_vectors(spark, sf_dir).withColumn("team_id", club), "candidates")
    a_pass = F.col("action_type") == "Pass"
    sums = stored(
        f.groupBy("team_id", "position_group", "match_id", "player_id").agg(
            F.count("*").alias("actions"), P.total(a_pass).alias("passes"), F.sum(F.when(a_pass, F.col("expected_completion")).otherwise(0.0)).alias("expected"), P.total(a_pass & F.col("under_pressure")).alias("pressure"), P.total(a_pass & F.col("progressive")).alias("progressive"), P.total(a_pass & (F.col("pass_length") >= 30)).alias("long"),
            F.sum(F.when(a_pass & (F.col("forward_distance") > 0), F.col("forward_distance")).otherwise(0.0)).alias("forward"),
        ), "team-sums",
    )
    eligible = style_profile_player(spark, sf_dir).where("position_group <> 'GK' and passes >= 50 and carries >= 29")
    stats = F.broadcast(eligible.groupBy("position_group").agg(*[x for i, c in enumerate(P.STYLE) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]))  # a row per group

    def roles(rows, run):
        t = {c: F.sum(c) for c in ("actions", "passes", "expected", "pressure", "progressive", "long", "forward")}
        rates = [t["expected"] / t["passes"], t["pressure"] / t["passes"], t["progressive"] / t["passes"], t["long"] / t["passes"], 100.0 * t["forward"] / t["passes"], (t["actions"] - t["passes"]) / t["actions"]]
        per = rows.where("position_group <> 'GK'").groupBy(run, "team_id", "position_group").agg(t["passes"].alias("n"), *[r.alias(f"f{i}") for i, r in enumerate(rates)]).where("n > 0").join(stats, "position_group")
        return stored(per.select(run, "team_id", "position_group", F.array(*[(F.col(f"f{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(DIMS)]).alias("rv")), "roles")

    whole = roles(sums.withColumn("whole", F.lit(0)), "whole").drop("whole")
    resampled = roles(sums.join(F.broadcast(X.resamples(sums, "match_id", _R, round_up=True)), "match_id"), "resample")  # a row per match and resample
    halves = roles(sums.join(_halves(spark, sf_dir).select("player_id", "match_id", "half"), ["player_id", "match_id"]), "half")
    keys = ["team_id", "position_group"]

    def ranks(r, runs, name):
        c = s.select("player_id", F.col("team_id").alias("of_team"), "position_group", "v")
        d = r.join(c, "position_group").where("of_team <> team_id").withColumn("d", F.round(V.rms(F.col("rv"), F.col("v")), 9))
        return d.select(*runs, *keys, "player_id", F.row_number().over(Window.partitionBy(*runs, *keys).orderBy("d", "player_id")).alias(name))

    full = stored(ranks(whole, [], "x"), "full-ranks")
    both = lambda other: full.join(other, [*keys, "player_id"])
    top = F.count(F.when((F.col("x") <= 6) & (F.col("y") <= 6), 1)) / 6.0
    over = both(ranks(resampled, ["resample"], "y")).groupBy("resample", *keys).agg(top.alias("o")).groupBy(*keys).agg(F.percentile("o", 0.5).alias("median_top6"))
    n = F.count("*").cast("double")
    first = both(ranks(halves.where("half = 'first'"), [], "y")).groupBy(*keys).agg(top.alias("candidate_top6"), F.when(n >= 3, 1 - 6 * F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))) / (n * (n * n - 1))).alias("candidate_spearman"))
    away = lambda a, b, on: a.join(b.withColumnRenamed("rv", "bv"), on).withColumn("d", V.rms(F.col("rv"), F.col("bv")))
    apart = away(halves.where("half = 'first'").drop("half"), halves.where("half = 'second'").drop("half"), keys).select(*keys, F.col("d").alias("half_distance"))
    moved = away(whole, resampled, keys).groupBy(*keys).agg(F.percentile("d", 0.5).alias("median_resample"))
    share = I.concentration(f, keys, "player_id").select(*keys, "players", (F.col("note") == "concentrated").alias("concentrated"))
    found = whole.select(*keys).join(share, keys)
    for part in (apart, moved, over, first):
        found = found.join(part, keys, "left")
    return found


# Archetypes: the best of a hundred restarts ----------------------------------------------------------------------------------

_HUNDRED = 100


def _archetypes(spark, sf_dir):
    """(player_id, v, reference) of the two clusters with the least inertia."""
    rows = stored(style_vectors(spark, sf_dir).select("player_id", "v"), "archetype-rows")
    _, reference = C.Fits(C.with_runs(rows, "player_id", "v", 1), "player_id", 2, _HUNDRED, ROUNDS).labels(1)
    return stored(rows.join(reference, "player_id"), "archetypes")


_ARCHETYPES_SQL = "with " + _lloyd_sql(1, 0, 2, _HUNDRED) + f", c9 as (select reference as l, {_MEANS} as c from ref group by 1), d9 as (select player_id, reference, l, {_DC} as d from ref, c9), m9 as (select player_id, reference, max(d) filter (l = reference) as distance, min(d) filter (l <> reference) as second from d9 group by 1, 2)"


@query(
    "fitted_archetype_players",
    _ARCHETYPES_SQL + " select m9.player_id, s_name as player_name, n_name as team_name, reference::integer as archetype, round(distance, 6) as distance, round((second - distance)/greatest(second, 1e-12), 6) as margin from m9 join supplier on player_id = s_suppkey join nation on s_nationkey = n_nationkey",
)
def fitted_archetype_players(spark, sf_dir):
    """Each eligible player with the fitted archetype, and how clear it is."""
    m = R.margins(_archetypes(spark, sf_dir), "player_id", "v", "reference").join(players(spark, sf_dir), "player_id")
    return m.select("player_id", "player_name", "team_name", F.col("reference").alias("archetype"), F.round("distance", 6).alias("distance"), F.round("margin", 6).alias("margin"))



@query(
    "role_fit_archetypes",
    _ARCHETYPES_SQL
    + ", s8 as (select * from s), r8 as (select team_id, position_group, " + _MEANS + " as v from s8 group by 1, 2), d8 as (select b.team_id, a.player_id, a.position_group, " + _RMS + " as distance from s8 a join r8 b on a.position_group = b.position_group and a.team_id <> b.team_id), "
    "k8 as (select *, row_number() over (partition by team_id, position_group order by round(distance, 9), player_id) as rank from d8) select k8.team_id, k8.position_group, k8.player_id, rank::integer as rank, round(k8.distance, 6) as role_distance, reference::integer as archetype from k8 left join m9 on k8.player_id = m9.player_id where rank <= 5",
)
def role_fit_archetypes(spark, sf_dir):
    """The best five outsiders of each role with their archetype, if they have one."""
    known = _archetypes(spark, sf_dir).select("player_id", F.col("reference").alias("archetype"))
    d = _role_distances(spark, sf_dir)
    top = d.withColumn("rank", F.row_number().over(Window.partitionBy("team_id", "position_group").orderBy("distance", "player_id"))).where("rank <= 5")
    return top.join(known, "player_id", "left").select("team_id", "position_group", "player_id", "rank", F.round("distance", 6).alias("role_distance"), "archetype")
