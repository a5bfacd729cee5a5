"""Registered distance, neighbour, role-fit, overlap and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import metrics as M
from touchline.operators import profiles as P
from touchline.operators import sequences as S
from touchline.operators import similarity as V
from touchline.plans.base import query
from touchline.plans.profiles import FEATURES_SQL, features, style_sql
from touchline.sources import views
from touchline.sources.scratch import stored
from touchline.sources.views import PASSES_SQL

DIMS = len(P.STYLE)
_VEC = "list_value(" + ", ".join(f"({f} - avg({f}) over w)/nullif(stddev_pop({f}) over w, 0)" for f in P.STYLE) + ")"
STYLE_VECTORS_SQL = f"select player_id, position_group, team_id, {_VEC} as v from ({style_sql('player_id, position_group, team_id')}) where position_group <> 'GK' and passes >= 50 and carries >= 29 window w as (partition by position_group)"


def style_vectors(spark, sf_dir):
    """z-scored style vectors of eligible outfield players."""
    s = P.style_profile(features(spark, sf_dir), ["player_id", "position_group", "team_id"]).where("position_group <> 'GK' and passes >= 50 and carries >= 29")
    z = S.zscores(s, "position_group", P.STYLE)
    return z.select("player_id", "position_group", "team_id", F.array(*[F.col(f"z_{f}") for f in P.STYLE]).alias("v"))


_RMS = f"sqrt(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (a.v[i]-b.v[i])*(a.v[i]-b.v[i])))/{DIMS})"
_COS = "1 - list_dot_product(a.v, b.v)/(sqrt(list_dot_product(a.v, a.v))*sqrt(list_dot_product(b.v, b.v)))"
_MAN = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: abs(a.v[i]-b.v[i])))/{DIMS}"


def _pairs_sql(d: str, op: str = "<>") -> str:
    return f"with s as ({STYLE_VECTORS_SQL}), d as (select a.position_group as grp, a.player_id as left_id, b.player_id as right_id, {d} as distance from s a join s b on a.position_group = b.position_group and a.player_id {op} b.player_id)"


@query("pair_distances", _pairs_sql(_RMS, "<") + " select grp, left_id, right_id, round(distance, 6) as distance from d")
def pair_distances(spark, sf_dir):
    return V.pairs(style_vectors(spark, sf_dir), "player_id", "position_group", "v", unique=True, dims=DIMS).withColumn("distance", V.rounded(F.col("distance"), 6))


@query("d50", _pairs_sql(_RMS, "<") + " select grp, count(*) as pairs, round(median(distance), 6) as d50 from d where distance > 0 group by 1")
def d50(spark, sf_dir):
    return V.d50(style_vectors(spark, sf_dir), "player_id", "position_group", "v").withColumn("d50", F.round("d50", 6))


def _neighbours(metric: str, sql: str):
    @query(f"neighbours_{metric}", _pairs_sql(sql) + " select left_id, right_id, round(distance, 6) as distance, rank from (select *, row_number() over (partition by left_id order by round(distance, 9), right_id)::integer as rank from d) where rank <= 10")
    def neighbours(spark, sf_dir):
        found = V.neighbours(style_vectors(spark, sf_dir), "player_id", "position_group", "v", 10, metric)
        return found.select("left_id", "right_id", F.round("distance", 6).alias("distance"), "rank")

    return neighbours


neighbours_rms, neighbours_cosine, neighbours_manhattan = (_neighbours(m, s) for m, s in (("rms", _RMS), ("cosine", _COS), ("manhattan", _MAN)))


@query(
    "similar_players",
    _pairs_sql(_RMS) + ", m as (select grp, median(distance) as d50 from d where distance > 0 and left_id < right_id group by 1) select d.left_id, d.right_id, round(100*exp(-ln(2)*distance/d50), 4) as similarity from d join m on d.grp = m.grp",
)
def similar_players(spark, sf_dir):
    s = stored(style_vectors(spark, sf_dir), "style-vectors")
    pairs = V.pairs(s, "player_id", "position_group", "v", dims=DIMS)
    half = V.d50(s, "player_id", "position_group", "v").select("grp", "d50")
    return pairs.join(F.broadcast(half), "grp").select("left_id", "right_id", V.rounded(T.similarity_index(F.col("distance"), F.col("d50")), 4).alias("similarity"))  # a row per group


@query(
    "similar_players_ranked",
    _pairs_sql(_RMS) + ", m as (select grp, median(distance) as d50 from d where distance > 0 and left_id < right_id group by 1), r as (select *, row_number() over (partition by left_id order by round(distance, 9), right_id)::integer as rank from d) "
    "select r.left_id, r.right_id, rank, round(distance, 6) as distance, round(case when distance = 0 then 100 else 100*exp(-ln(2)*distance/d50) end, 4) as similarity from r left join m on r.grp = m.grp where rank <= 10",
)
def similar_players_ranked(spark, sf_dir):
    """The ten most similar players of every player."""
    s = stored(style_vectors(spark, sf_dir), "style-vectors")
    ranked = V.neighbours(s, "player_id", "position_group", "v")
    half = V.d50(s, "player_id", "position_group", "v").select("grp", "d50")
    index = F.when(F.col("distance") == 0, 100.0).otherwise(T.similarity_index(F.col("distance"), F.col("d50")))
    return ranked.join(F.broadcast(half), "grp", "left").select("left_id", "right_id", "rank", F.round("distance", 6).alias("distance"), F.round(index, 4).alias("similarity"))  # a row per group


_NAMES = "[" + ", ".join(f"'{f}'" for f in P.STYLE) + "]"


@query(
    "closest_dimensions",
    f"with s as ({STYLE_VECTORS_SQL}), r as (select position_group, list_value({', '.join(f'avg(v[{i + 1}])' for i in range(DIMS))}) as c from s group by 1), g as (select player_id, unnest(range(1, {DIMS + 1})) as i, s.v, c from s join r on s.position_group = r.position_group), k as (select player_id, {_NAMES}[i] as name, abs(v[i]-c[i]) as gap, i from g) "
    "select player_id, array_to_string(list(name order by round(gap, 9), i)[1:3], ',') as closest, last(name order by round(gap, 9), i) as furthest from k group by 1",
)
def closest_dimensions(spark, sf_dir):
    s = style_vectors(spark, sf_dir)
    centres = s.groupBy("position_group").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIMS)]).alias("c"))
    ordered = V.gaps(F.transform("v", lambda x: F.round(x, 9)), F.transform("c", lambda x: F.round(x, 9)), P.STYLE)
    listed = F.array_sort(F.transform(ordered, lambda g: F.struct(F.round(g["gap"], 9).alias("gap"), g["place"].alias("place"), g["name"].alias("name"))))
    j = s.join(F.broadcast(centres), "position_group").withColumn("g", listed)  # a centre per group
    return j.select("player_id", F.array_join(F.transform(F.slice("g", 1, 3), lambda g: g["name"]), ",").alias("closest"), F.element_at("g", -1)["name"].alias("furthest"))


@query(
    "distance_contributions",
    f"with s as ({STYLE_VECTORS_SQL}), d as (select a.player_id as left_id, b.player_id as right_id, list_transform(range(1, {DIMS + 1}), lambda i: (a.v[i]-b.v[i])*(a.v[i]-b.v[i])) as sq from s a join s b on a.position_group = b.position_group and a.player_id < b.player_id) "
    "select left_id, right_id, round(sq[1]/list_sum(sq), 6) as first_share, round(list_max(sq)/list_sum(sq), 6) as largest_share from d",
)
def distance_contributions(spark, sf_dir):
    s = style_vectors(spark, sf_dir)
    pairs = V.blocked_pairs(s.select("position_group", "player_id", "v"), "player_id", ["position_group"], unique=True)
    c = pairs.withColumn("c", V.contributions(F.col("a"), F.col("b"), DIMS))
    return c.select("left_id", "right_id", V.rounded(F.get("c", F.lit(0)), 6).alias("first_share"), V.rounded(F.array_max("c"), 6).alias("largest_share"))


ROLE_SQL = f"with s as ({STYLE_VECTORS_SQL}), r as (select team_id, position_group, list_value({', '.join(f'avg(v[{i + 1}])' for i in range(DIMS))}) as v from s group by 1, 2), d as (select b.team_id, a.player_id, a.position_group, {_RMS} as distance from s a join r b on a.position_group = b.position_group and a.team_id <> b.team_id)"


def _role_distances(spark, sf_dir):
    s = style_vectors(spark, sf_dir)
    roles = s.groupBy("team_id", "position_group").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIMS)]).alias("rv")).withColumnRenamed("team_id", "target")
    j = s.join(roles, "position_group").where(F.col("team_id") != F.col("target"))
    return j.select(F.col("target").alias("team_id"), "player_id", "position_group", F.round(V.rms(F.col("v"), F.col("rv")), 9).alias("distance"))


@query("role_vector_fit", ROLE_SQL + " select team_id, position_group, count(*) as candidates, round(min(distance), 6) as best, round(avg(distance), 6) as mean from d group by 1, 2")
def role_vector_fit(spark, sf_dir):
    d = _role_distances(spark, sf_dir)
    return d.groupBy("team_id", "position_group").agg(F.count("*").alias("candidates"), F.round(F.min("distance"), 6).alias("best"), F.round(F.avg("distance"), 6).alias("mean"))


@query("role_fit_rank", ROLE_SQL + " select team_id, position_group, player_id, rank, cohort from (select *, row_number() over (partition by team_id, position_group order by round(distance, 9), player_id)::integer as rank, count(*) over (partition by team_id, position_group) as cohort from d) where rank <= 5")
def role_fit_rank(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("team_id", "position_group")
    ranked = _role_distances(spark, sf_dir).withColumns({"rank": F.row_number().over(w.orderBy("distance", "player_id")), "cohort": F.count("*").over(w)})
    return ranked.where("rank <= 5").select("team_id", "position_group", "player_id", "rank", "cohort")


@query(
    "centroid_margins",
    "with c as (select label, " + ", ".join(f"avg(embedding[{i + 1}]::double) as c{i}" for i in range(64)) + " from embeddings group by 1), d as (select vec_id, c.label, sqrt((" + "+".join(f"(embedding[{i + 1}]-c{i})*(embedding[{i + 1}]-c{i})" for i in range(64)) + ")/64) as d from embeddings, c), r as (select *, row_number() over (partition by vec_id order by d, label) as r from d) "
    "select vec_id, max(label) filter (r = 1) as nearest, round(max(d) filter (r = 1), 5) as distance, round(max(d) filter (r = 2) - max(d) filter (r = 1), 5) as margin from r where r <= 2 group by 1",
)
def centroid_margins(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centres = e.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(64)]).alias("c"))
    m = V.margins(e, "vec_id", "v", centres, "label", "c")
    return m.select("vec_id", "nearest", F.round("distance", 5).alias("distance"), F.round("margin", 5).alias("margin"))


@query(
    "topk_overlap_jaccard",
    _pairs_sql(_RMS).replace("with s", "with s", 1) + f", e as (select a.player_id as left_id, b.player_id as right_id, {_MAN} as distance from s a join s b on a.position_group = b.position_group and a.player_id <> b.player_id), x as (select left_id, list(right_id) as l from (select *, row_number() over (partition by left_id order by round(distance, 9), right_id) as r from d) where r <= 10 group by 1), y as (select left_id, list(right_id) as l from (select *, row_number() over (partition by left_id order by round(distance, 9), right_id) as r from e) where r <= 10 group by 1) "
    "select x.left_id, len(list_intersect(x.l, y.l))::integer as shared, round(len(list_intersect(x.l, y.l))/len(list_distinct(list_concat(x.l, y.l)))::double, 6) as jaccard from x join y on x.left_id = y.left_id",
)
def topk_overlap_jaccard(spark, sf_dir):
    return V.overlap(neighbours_rms(spark, sf_dir), neighbours_manhattan(spark, sf_dir), "left_id", "right_id")


# Quality of predictions ------------------------------------------------------------------------------------------------

_YP = f"select completed as y, expected_completion as p from ({PASSES_SQL})"


def _yp(spark, sf_dir):
    return views.actions(spark, sf_dir).select(F.col("completed").alias("y"), F.col("expected_completion").alias("p"))


@query(
    "probability_metrics",
    f"with d as ({_YP}), r as (select y, p, rank() over (order by p) + (count(*) over (partition by p) - 1)/2.0 as r from d), c as (select *, greatest(1e-7, least(1-1e-7, p)) as q from r) "
    "select count(*) as n, cast(sum(y) as bigint) as positives, round(-avg(case when y = 1 then ln(q) else ln(1-q) end), 6) as log_loss, round(avg((p-y)*(p-y)), 6) as brier, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, round((sum(r) filter (y = 1) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y)))::double, 6) as auc from c",
)
def probability_metrics(spark, sf_dir):
    return M.probability_metrics(_yp(spark, sf_dir), "y", "p")


@query("reliability_curve", f"select greatest(ceil(p*10), 1)::integer as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from ({_YP}) group by 1")
def reliability_curve(spark, sf_dir):
    return M.reliability_curve(_yp(spark, sf_dir), "y", "p")


@query("ece", f"with b as (select greatest(ceil(p*10), 1) as bin, count(*) as n, avg(p) as a, avg(y) as o from ({_YP}) group by 1) select cast(sum(n) as bigint) as n, round(sum(n*abs(a-o))/sum(n), 6) as ece from b")
def ece(spark, sf_dir):
    return M.calibration_error(_yp(spark, sf_dir), "y", "p")


@query("regression_metrics", "with d as (select l_extendedprice as y, l_quantity*1500 as p from lineitem) select count(*) as n, round(avg(abs(y-p)), 6) as mae, round(sqrt(avg((y-p)*(y-p))), 6) as rmse, round(1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)), 6) as r2, round(corr(y, p), 6) as pearson from d")
def regression_metrics(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return M.regression_metrics(line, "y", "p")


@query(
    "confusion_f1",
    "with d as (select l_returnflag as a, case when l_quantity < 20 then 'A' when l_quantity < 35 then 'N' else 'R' end as p from lineitem), l as (select a as label from d union select p from d), c as (select label, count(*) filter (a = label and p = label) as tp, count(*) filter (a <> label and p = label) as fp, count(*) filter (a = label and p <> label) as fn from l, d group by 1) "
    "select *, round(tp/nullif(tp+fp, 0)::double, 6) as precision, round(tp/nullif(tp+fn, 0)::double, 6) as recall, round(2*tp/nullif(2*tp+fp+fn, 0)::double, 6) as f1 from c",
)
def confusion_f1(spark, sf_dir):
    p = F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("a"), p.alias("p"))
    return M.class_scores(rows, "a", "p")


@query(
    "adjusted_rand",
    "with d as (select l_returnflag as a, l_linestatus as b, count(*)::double as n from lineitem group by 1, 2), i as (select sum(n*(n-1)/2) as idx, sum(n)*(sum(n)-1)/2 as t from d), l as (select sum(n*(n-1)/2) as l from (select sum(n) as n from d group by a)), r as (select sum(n*(n-1)/2) as r from (select sum(n) as n from d group by b)) select round((idx - l*r/t)/((l+r)/2 - l*r/t), 6) as adjusted_rand from i, l, r",
)
def adjusted_rand(spark, sf_dir):
    return M.adjusted_rand(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_linestatus")


@query("format_labels", f"select position_group, count(*) as n, case when count(*) % 100 in (11, 12, 13) then count(*)::varchar || 'th' when count(*) % 10 = 1 then count(*)::varchar || 'st' when count(*) % 10 = 2 then count(*)::varchar || 'nd' when count(*) % 10 = 3 then count(*)::varchar || 'rd' else count(*)::varchar || 'th' end as ordinal from ({FEATURES_SQL}) group by 1")
def format_labels(spark, sf_dir):
    counted = features(spark, sf_dir).groupBy("position_group").agg(F.count("*").alias("n"))
    return counted.withColumn("ordinal", T.ordinal(F.col("n")))


@query("chart_coordinates", f"select player_id, round(avg(greatest(0, least(100, end_x/120*100))), 6) as x, round(avg(greatest(0, least(100, (80-end_y)/80*100))), 6) as y from ({PASSES_SQL}) group by 1")
def chart_coordinates(spark, sf_dir):
    from touchline.functions import pitch

    rows = views.passes(spark, sf_dir)
    return rows.groupBy("player_id").agg(F.round(F.avg(pitch.chart_x(F.col("end_x"))), 6).alias("x"), F.round(F.avg(pitch.chart_y(F.col("end_y"))), 6).alias("y"))


@query("calibrated_probability", f"select round(p, 6) as p, round(1/(1+exp(-greatest(-35, least(35, (p-0.7)*20/1.5)))), 6) as calibrated, count(*) as n from ({_YP}) group by 1, 2")
def calibrated_probability(spark, sf_dir):
    c = _yp(spark, sf_dir).select(F.round("p", 6).alias("p"), F.round(T.logistic((F.col("p") - 0.7) * 20, 1.5), 6).alias("calibrated"))
    return c.groupBy("p", "calibrated").agg(F.count("*").alias("n"))
