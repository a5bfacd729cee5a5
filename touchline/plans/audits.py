"""Registered audits, reports on vectors and labels, and stability of neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import profiles as P
from touchline.operators import reports as R
from touchline.operators import selection as X
from touchline.operators import sequences as S
from touchline.operators import similarity as V
from touchline.plans.base import query
from touchline.plans.pages import _embedded, _read
from touchline.plans.profiles import FEATURES_SQL, PROFILE_SQL, features, passing_profile, style_profile_player, style_sql
from touchline.plans.sequences import HALVES_SQL, _halves
from touchline.plans.vectors import _MAN, _RMS, DIMS, ROLE_SQL, STYLE_VECTORS_SQL, _pairs_sql, _role_distances, neighbours_manhattan, neighbours_rms, style_vectors, topk_overlap_jaccard
from touchline.sources import views
from touchline.sources.views import PASSES_SQL, SHOTS_SQL

# Players ---------------------------------------------------------------------------------------------------------------

_MISSING = " or ".join(f"{f} is null" for f in P.STYLE)
_REASON = f"case when position_group = 'GK' then 'goalkeeper' when passes < 50 then 'requires_50_passes' when carries < 29 then 'requires_29_carries' when {_MISSING} then 'features_unavailable' else 'eligible' end"


@query("ineligibility_reason", f"select player_id, {_REASON} as reason from ({style_sql('player_id, position_group')})")
def ineligibility_reason(spark, sf_dir):
    """Why a player has no archetype: the first reason that holds."""
    return style_profile_player(spark, sf_dir).select("player_id", F.expr(_REASON).alias("reason"))


_THRESHOLDS = [2, 3, 4, 5, 6, 8, 10, 15]


@query("support_calibration", f"select threshold::integer as threshold, count(*) as eligible, round(avg(matches), 6) as mean_observed, count(*) >= 20 as meaningful from ({PROFILE_SQL}), (select unnest({_THRESHOLDS}) as threshold) where matches >= threshold group by 1")
def support_calibration(spark, sf_dir):
    return R.support(passing_profile(spark, sf_dir), "matches", _THRESHOLDS)


_SUBSETS = ("all", "pressure", "progressive", "long")
_RATES = [f"{s}_{r}" for s in _SUBSETS for r in ("rate", "expected_rate")]
_OUTSIDE = " or ".join(f"{r} < 0 or {r} > 1" for r in _RATES)
_FILLED = " or ".join(f"({s}_attempts = 0 and ({s}_rate is not null or {s}_expected_rate is not null or {s}_above_expected_pp is not null))" for s in _SUBSETS)
_CONSERVED = (
    "select p.players, p.players - p.ids as repeated_players, p.attempts - r.n as attempts_gap, p.completed - r.completed as completed_gap, abs(p.expected/p.attempts - r.expected) > 0.000001 as expected_differs, p.outside, p.filled from p, r"
)


@query(
    "profile_conservation",
    f"with p as (select count(*) as players, count(distinct player_id) as ids, cast(sum(all_attempts) as bigint) as attempts, cast(sum(all_completed) as bigint) as completed, sum(all_expected_rate*all_attempts) as expected, count(*) filter ({_OUTSIDE}) as outside, count(*) filter ({_FILLED}) as filled from ({PROFILE_SQL})), "
    f"r as (select count(*) as n, cast(sum(completed) as bigint) as completed, avg(expected_completion) as expected from ({PASSES_SQL})) {_CONSERVED}",
)
def profile_conservation(spark, sf_dir):
    """Profiles against the rows they are made of: nothing is lost or counted twice, rates stay in bounds, what has no attempts is null."""
    count = lambda condition: F.count(F.when(F.expr(condition), 1))
    p = passing_profile(spark, sf_dir).agg(
        F.count("*").alias("players"), F.countDistinct("player_id").alias("ids"), F.sum("all_attempts").alias("attempts"), F.sum("all_completed").alias("completed"),
        F.sum(F.col("all_expected_rate") * F.col("all_attempts")).alias("expected"), count(_OUTSIDE).alias("outside"), count(_FILLED).alias("filled"),
    )
    r = views.passes(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("completed").alias("completed"), F.avg("expected_completion").alias("expected"))
    return spark.sql(_CONSERVED.replace("from p, r", "from {p} p, {r} r"), p=p, r=r)  # one row each


_BROKEN = "count(*) as fits, count(*) filter (where distance < 0 or distance is null) as bad_distances, count(*) filter (where position_group = 'GK') as goalkeepers, count(*) filter (where again > 1) as repeated, count(*) filter (where before > distance) as not_ascending"


@query("role_fit_audit", ROLE_SQL + f", w as (select position_group, round(distance, 9) as distance, count(*) over (partition by team_id, position_group, player_id) as again, lag(round(distance, 9)) over (partition by team_id, position_group order by round(distance, 9), player_id) as before from d) select {_BROKEN} from w")
def role_fit_audit(spark, sf_dir):
    """How many rows of the role fits break a rule; all but the number of fits should be 0."""
    role = Window.partitionBy("team_id", "position_group")
    fits = _role_distances(spark, sf_dir)
    checked = fits.withColumns({"again": F.count("*").over(Window.partitionBy("team_id", "position_group", "player_id")), "before": F.lag("distance").over(role.orderBy("distance", "player_id"))})
    return spark.sql(f"select {_BROKEN} from {{checked}}", checked=checked)


# Vectors ---------------------------------------------------------------------------------------------------------------

_D = 64


@query(
    "distance_shares",
    "with l as (select label, vec_id, unnest(range(64))::integer as dim, unnest(embedding)::double as x from embeddings), m as (select a.label, a.dim, avg((a.x-b.x)*(a.x-b.x)) as m from l a join l b on a.label = b.label and a.dim = b.dim and a.vec_id < b.vec_id group by 1, 2) select label, dim, round(m, 6) as mean_squared, round(m/sum(m) over (partition by label), 6) as share from m",
)
def distance_shares(spark, sf_dir):
    d = R.distance_shares(_embedded(spark, sf_dir), "label", "v")
    return d.where("mean_squared is not null").select("label", "dim", F.round("mean_squared", 6).alias("mean_squared"), F.round("share", 6).alias("share"))


@query(
    "distinguishing_dimensions",
    "with l as (select label, unnest(range(64))::integer as dim, unnest(embedding)::double as x from embeddings), w as (select dim, avg(x) as m, stddev_pop(x) as s from l group by 1), z as (select l.label, l.dim, round((avg(x) - any_value(m))/nullif(any_value(s), 0), 6) as z from l join w on l.dim = w.dim group by 1, 2) "
    "select * from (select label, dim, z, row_number() over (partition by label order by abs(z) desc, dim)::integer as rank from z) where rank <= 4",
)
def distinguishing_dimensions(spark, sf_dir):
    return R.distinguishing(_embedded(spark, sf_dir), "label", "v").select("label", "dim", "z", "rank")


@query(
    "role_vector_summary",
    f"with s as ({STYLE_VECTORS_SQL}), r as (select team_id, position_group, list_value({', '.join(f'avg(v[{i + 1}])' for i in range(DIMS))}) as w from s group by 1, 2), "
    "e as (select player_id, round(unnest(v), 9) as x, round(unnest(w), 9) as y from s join r on s.team_id = r.team_id and s.position_group = r.position_group), "
    "k as (select *, rank() over (partition by player_id order by x) + (count(*) over (partition by player_id, x) - 1)/2.0 as rx, rank() over (partition by player_id order by y) + (count(*) over (partition by player_id, y) - 1)/2.0 as ry from e) "
    "select player_id, round(sqrt(avg((x-y)*(x-y))), 6) as rms, round(sum(x*y)/nullif(sqrt(sum(x*x))*sqrt(sum(y*y)), 0), 6) as cosine, round(corr(rx, ry), 6) as spearman from k group by 1",
)
def role_vector_summary(spark, sf_dir):
    """A player's style beside the mean of the team's players in the role."""
    s = style_vectors(spark, sf_dir)
    roles = s.groupBy("team_id", "position_group").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIMS)]).alias("w"))
    return R.vector_summary(s.join(roles, ["team_id", "position_group"]), "player_id", "v", "w")


def _top_sql(source: str, k: int = 10) -> str:
    return f"(select * from (select left_id, right_id, row_number() over (partition by left_id order by round(distance, 9), right_id)::integer as rank from {source}) where rank <= {k})"


_BOTH_SQL = _pairs_sql(_RMS) + f", e as (select a.player_id as left_id, b.player_id as right_id, {_MAN} as distance from s a join s b on a.position_group = b.position_group and a.player_id <> b.player_id), x as {_top_sql('d')}, y as {_top_sql('e')}"


@query("ranking_changes", _BOTH_SQL + " select x.left_id, x.right_id, x.rank as rank_rms, y.rank as rank_manhattan, y.rank - x.rank as change from x join y on x.left_id = y.left_id and x.right_id = y.right_id")
def ranking_changes(spark, sf_dir):
    """Candidates that both distances have among their ten, with both ranks."""
    a = neighbours_rms(spark, sf_dir).select("left_id", "right_id", F.col("rank").alias("rank_rms"))
    b = neighbours_manhattan(spark, sf_dir).select("left_id", "right_id", F.col("rank").alias("rank_manhattan"))
    return a.join(b, ["left_id", "right_id"]).withColumn("change", F.col("rank_manhattan") - F.col("rank_rms"))


@query("weakest_rankings", _BOTH_SQL + ", n as (select x.left_id, count(y.right_id)::integer as shared from x left join y on x.left_id = y.left_id and x.right_id = y.right_id group by 1) select left_id, shared from n order by shared, left_id limit 5")
def weakest_rankings(spark, sf_dir):
    """The five players whose neighbours depend most on the distance."""
    return topk_overlap_jaccard(spark, sf_dir).select("left_id", "shared").orderBy("shared", "left_id").limit(5)


_HALF_SOURCE = f"select f.*, h.half from ({FEATURES_SQL}) f join ({HALVES_SQL}) h on f.player_id = h.player_id and f.match_id = h.match_id"
_HALF_VEC = "list_value(" + ", ".join(f"({f} - avg({f}) over w)/nullif(stddev_pop({f}) over w, 0)" for f in P.STYLE) + ")"
_HALF_KEPT = "position_group <> 'GK' and passes >= 25 and carries >= 15"


@query(
    "neighbour_stability",
    f"with s as (select player_id, half, position_group, {_HALF_VEC} as v from ({style_sql('player_id, position_group, half', _HALF_SOURCE)}) where {_HALF_KEPT} window w as (partition by position_group, half)), d as (select a.player_id as left_id, b.player_id as right_id, a.half, {_RMS} as distance from s a join s b on a.position_group = b.position_group and a.half = b.half and a.player_id <> b.player_id), "
    "t as (select left_id, half, list(right_id) as l from (select *, row_number() over (partition by left_id, half order by round(distance, 9), right_id) as rank from d) where rank <= 6 group by 1, 2) "
    "select x.left_id, len(list_intersect(x.l, y.l))::integer as shared, round(len(list_intersect(x.l, y.l))/len(list_distinct(list_concat(x.l, y.l)))::double, 6) as jaccard from t x join t y on x.left_id = y.left_id where x.half = 'first' and y.half = 'second'",
)
def neighbour_stability(spark, sf_dir):
    """How many of a player's six nearest in the first half of the matches are so in the second half."""
    half = _halves(spark, sf_dir).select("player_id", "match_id", "half")
    rows = features(spark, sf_dir).join(half, ["player_id", "match_id"])
    s = P.style_profile(rows, ["player_id", "position_group", "half"]).where(_HALF_KEPT).withColumn("pool", F.concat_ws("/", "position_group", "half"))
    z = S.zscores(s, "pool", P.STYLE).select("player_id", "pool", F.array(*[F.col(f"z_{f}") for f in P.STYLE]).alias("v"))
    top = V.neighbours(z, "player_id", "pool", "v", 6)
    return V.overlap(top.where("grp like '%/first'"), top.where("grp like '%/second'"), "left_id", "right_id")


# Resamples and labels --------------------------------------------------------------------------------------------------

_KINDS = {"completion": "completed", "attacking": "attacking_value", "expected": "expected_completion"}
_PER_MATCH = f"select position_group, match_id, count(*) as n, {', '.join(f'sum({c}) as {k}' for k, c in _KINDS.items())} from ({PASSES_SQL}) group by 1, 2"


@query(
    "feature_variation",
    f"with m as ({_PER_MATCH}), g as (select distinct match_id from m), r as (select match_id, resample::integer as resample, row_number() over (partition by resample order by md5(resample || ':' || match_id), match_id) as r, count(*) over (partition by resample) as n from g, range(20) t(resample)), "
    f"v as (select position_group, resample, {', '.join(f'sum({k})/sum(m.n)::double as {k}' for k in _KINDS)} from m join r on m.match_id = r.match_id where r <= round(r.n*0.8) group by 1, 2), u as (unpivot v on {', '.join(_KINDS)} into name feature value x) "
    "select position_group, feature, count(*) as resamples, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as least, round(median(x), 6) as middle, round(max(x), 6) as most from u group by 1, 2",
)
def feature_variation(spark, sf_dir):
    """Spread of each rate over resamples of whole matches; sums per match are multiplied, not events."""
    rows = views.passes(spark, sf_dir)
    per = rows.groupBy("position_group", "match_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in _KINDS.items()])
    rates = per.join(X.resamples(rows, "match_id", 20), "match_id").groupBy("position_group", "resample").agg(*[(F.sum(k) / F.sum("n")).alias(k) for k in _KINDS])
    long = rates.unpivot(["position_group", "resample"], list(_KINDS), "feature", "x").groupBy("position_group", "feature")
    six = lambda x: F.round(x, 6)
    return long.agg(F.count("*").alias("resamples"), six(F.avg("x")).alias("mean"), six(F.stddev_pop("x")).alias("std"), six(F.min("x")).alias("least"), six(F.median("x")).alias("middle"), six(F.max("x")).alias("most"))


@query("label_rates", "select quality, count(*) as n, round(count(*)/sum(count(*)) over ()::double, 6) as share, round(sum(count(*)) over ()/(select count(*) from documents)::double, 6) as coverage from labels where doc_id in (select doc_id from documents) group by 1")
def label_rates(spark, sf_dir):
    """Share of each label among the labelled, and how many of all documents are labelled."""
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    counted = _read(spark, sf_dir, "labels").join(docs, "doc_id", "left_semi").groupBy("quality").agg(F.count("*").alias("n"))
    labelled = F.sum("n").over(Window.partitionBy())  # a row per label
    every = docs.agg(F.count("*").alias("_all")).scalar()
    return counted.select("quality", "n", F.round(F.col("n") / labelled, 6).alias("share"), F.round(labelled / every, 6).alias("coverage"))


_FOLDED = (
    f"m as (select distinct match_id from ({SHOTS_SQL})), f as (select match_id, case when outer_fold <= 2 then 1 when outer_fold <= 4 then 2 else 3 end as inner_fold, outer_fold from (select match_id, (row_number() over (order by md5('outer:' || match_id), 'outer:' || match_id) - 1) % 5 + 1 as outer_fold from m))"
)


@query(
    "leakage_audit",
    f"with {_FOLDED}, s as (select inner_fold, outer_fold from ({SHOTS_SQL}) x join f on x.match_id = f.match_id) "
    "select h::integer as fold, count(*) as training, count(*) filter (exists (select 1 from f where f.outer_fold = h and f.inner_fold <> s.inner_fold)) as contaminated from s, range(1, 6) t(h) where outer_fold <> h group by 1",
)
def leakage_audit(spark, sf_dir):
    """Labels from a coarser first cross-fit, used inside a second one: how many saw a held-out match; those of the same coarse fold didn't."""
    shots = views.shots(spark, sf_dir).select("match_id", F.concat(F.lit("outer:"), F.col("match_id").cast("string")).alias("dealt"))
    outer = X.folds(shots, "dealt", 5).withColumnRenamed("fold", "outer_fold")
    inner = F.when(F.col("outer_fold") <= 2, 1).when(F.col("outer_fold") <= 4, 2).otherwise(3)
    return X.contaminated(shots.join(outer, "dealt").withColumn("inner_fold", inner), "inner_fold", "outer_fold", "match_id", 5)


_WANTED = ("Customer#000000017", "customer 00000001", "000000002 Customer", "nobody")


def _resolved_sql(wanted: str) -> str:
    n = " ".join("".join(c if c.isalnum() else " " for c in wanted.lower()).split())
    kind = f"case when n = '{n}' then 1 when contains(n, '{n}') then 2 when len(list_filter({n.split()}, lambda x: not list_contains(string_split(n, ' '), x))) = 0 then 3 end"
    best = f"select c_custkey, {kind} as c from (select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as n from customer)"
    return f"select '{wanted}' as query, case count(*) when 0 then 'NOT_FOUND' when 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, count(*) as candidates, case when count(*) = 1 then min(c_custkey) end as c_custkey from ({best}) where c = (select min(c) from ({best}))"


@query("entity_resolution", " union all ".join(_resolved_sql(w) for w in _WANTED))
def entity_resolution(spark, sf_dir):
    """A few stated names against all customers."""
    return X.resolved(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name", list(_WANTED))
