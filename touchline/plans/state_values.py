"""Registered queries on state values: quality, Tweedie and hurdle models, nested cross-fitting, temperature scaling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators import calibration as T
from touchline.operators import crossfit as X
from touchline.operators import model_choice as M
from touchline.operators import sequences as S
from touchline.operators import values as V
from touchline.operators.selection import folds, three_way_split
from touchline.plans.base import query
from touchline.plans.sequences import STATES_SQL, possessions, states
from touchline.sources import views
from touchline.sources.scratch import shared_folder, stored
from touchline.sources.views import PASSES_SQL

# Quality of values -------------------------------------------------------------------------------------------------------

_PAIR = f"select remaining_xg as y, greatest(next_5_xg*0.8 + 0.01, 0) as p from ({STATES_SQL})"


def _pair(spark, sf_dir):
    return states(spark, sf_dir).select(F.col("remaining_xg").alias("y"), (F.col("next_5_xg") * 0.8 + 0.01).alias("p"))


@query(
    "value_metrics",
    f"with d as ({_PAIR}), r as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1)/2.0 as ry, rank() over (order by p) + (count(*) over (partition by p) - 1)/2.0 as rp from d) "
    "select count(*) as n, round(avg(abs(y-p)), 6) as mae, round(sqrt(avg((y-p)*(y-p))), 6) as rmse, round(1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)), 6) as r2, round(avg(abs(y-p)) filter (y > 0), 6) as positive_mae, round(sqrt(avg((y-p)*(y-p)) filter (y > 0)), 6) as positive_rmse, round(min(p), 6) as prediction_min, round(max(p), 6) as prediction_max, round(corr(ry, rp), 6) as spearman from r",
)
def value_metrics(spark, sf_dir):
    m = V.value_metrics(_pair(spark, sf_dir), "y", "p")
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


_BUCKET = "case " + " ".join(f"when y <= {upto} then '{name}'" if upto is not None else f"else '{name}'" for name, _, upto in V.BUCKETS) + " end"


@query("value_buckets", f"select {_BUCKET} as bucket, count(*) as n, round(avg(abs(y-p)), 6) as mae, round(sqrt(avg((y-p)*(y-p))), 6) as rmse, round(avg(y), 6) as mean_actual, round(avg(p), 6) as mean_predicted from ({_PAIR}) group by 1")
def value_buckets(spark, sf_dir):
    b = V.value_buckets(_pair(spark, sf_dir), "y", "p")
    return b.select("bucket", "n", *[F.round(c, 6).alias(c) for c in b.columns[2:]])


# Models ------------------------------------------------------------------------------------------------------------------

_FOLDS = 3
_FOLD_SQL = f"select match_id, ((row_number() over (order by md5(match_id::varchar), match_id) - 1) % {_FOLDS} + 1)::integer as fold from (select distinct match_id from ({STATES_SQL}))"
_COLUMNS = V.Features(["action_number", "elapsed_s", "score_difference", "event_index"], ["first_of_match"], ["previous_type", "event_type"])


def _rows(spark, sf_dir):
    s = S.with_state(S.with_score(possessions(spark, sf_dir)))
    return s.select("event_id", "match_id", "possession_id", "event_index", "event_type", "previous_type", "action_number", "elapsed_s", "score_difference", (F.col("event_index") == 1).alias("first_of_match"), F.col("remaining_xg").alias("value"))


def _predicted(spark, sf_dir, fit):
    rows = _rows(spark, sf_dir)
    return V.cross_fitted(rows, folds(rows, "match_id", _FOLDS), "match_id", fit)


@query("tweedie_intercept", f"with d as (select fold, remaining_xg as v from ({STATES_SQL}) s join ({_FOLD_SQL}) f on s.match_id = f.match_id), t as (select fold, count(*) as n, sum(v) as v from d group by 1) select fold, n as rows, round((sum(v) over () - v)/(sum(n) over () - n), 5) as prediction from t")
def tweedie_intercept(spark, sf_dir):
    """Without features a Tweedie model predicts the mean of its training rows."""
    found = _predicted(spark, sf_dir, V.regressor(V.Features(), "value", "tweedie"))
    return found.groupBy("fold").agg(F.count("*").alias("rows"), F.round(F.avg("prediction"), 5).alias("prediction"))


@query(
    "hurdle_intercept",
    f"with d as (select fold, remaining_xg as v from ({STATES_SQL}) s join ({_FOLD_SQL}) f on s.match_id = f.match_id), t as (select fold, count(*) as n, count(*) filter (v > 0) as pos, sum(v) as v from d group by 1), o as (select fold, n as rows, (sum(pos) over () - pos)/(sum(n) over () - n)::double as probability, (sum(v) over () - v)/(sum(pos) over () - pos) as magnitude from t) "
    "select fold, rows, round(probability, 5) as probability, round(magnitude, 5) as magnitude, round(probability*magnitude, 5) as prediction from o",
)
def hurdle_intercept(spark, sf_dir):
    found = _predicted(spark, sf_dir, V.hurdle(V.Features(), "value"))
    return found.groupBy("fold").agg(F.count("*").alias("rows"), *[F.round(F.avg(c), 5).alias(c) for c in ("probability", "magnitude", "prediction")])


def _model_query(name: str, fit):
    @query(name)
    def predicted(spark, sf_dir):
        found = _predicted(spark, sf_dir, fit)
        return found.select("event_id", "match_id", "fold", "value", *[c for c in ("probability", "magnitude") if c in found.columns], "prediction")

    return predicted


tweedie_oof = _model_query("tweedie_oof", V.regressor(_COLUMNS, "value", "tweedie", ridge=1e-3))
boosted_value_oof = _model_query("boosted_value_oof", V.regressor(_COLUMNS, "value", "squared", trees=5))
hurdle_oof = _model_query("hurdle_oof", V.hurdle(_COLUMNS, "value", ridge=1e-3))



@query("boosting_candidates")
def boosting_candidates(spark, sf_dir):
    """Three boosted models and a small network of whether something follows, scored on the validation matches."""
    rows = _rows(spark, sf_dir).withColumn("y", (F.col("value") > 0).cast("int"))
    dealt = stored(rows.join(three_way_split(rows, "match_id"), "match_id"), "candidates-split")
    train, held = dealt.where("part = 'train'"), dealt.where("part = 'validation'").select("event_id", "y", *_COLUMNS.numbers, *_COLUMNS.flags, *_COLUMNS.categories)
    models = {"shallow": {"kind": "trees", "trees": 5, "depth": 2}, "deeper": {"kind": "trees", "trees": 5, "depth": 4}, "longer": {"kind": "trees", "trees": 10, "depth": 3}, "network": {"kind": "network", "trees": 30}}
    predict = V.classifiers(_COLUMNS, "value > 0", {f"p_{name}": how for name, how in models.items()})(train)
    scored = stored(predict(held).select("y", *[f"p_{name}" for name in models]), "candidates")
    return M.scored_candidates(scored, "y", {name: F.col(f"p_{name}") for name in models})


# Nested cross-fitting ----------------------------------------------------------------------------------------------------

_NESTED = (
    f"with st as materialized (select event_id as id, match_id as grp, previous_type as c, (remaining_xg > 0)::int as y from ({STATES_SQL})), g as (select distinct grp from st), f as (select grp, (row_number() over (order by md5(grp::varchar), grp) - 1) % 5 + 1 as own from g), "
    "e as (select grp, o as outer_fold, own = o as held from f, (select unnest(range(1, 6)) as o)), d as materialized (select *, case when held then 0 else (row_number() over (partition by outer_fold, held order by md5(grp::varchar), grp) - 1) % 5 + 1 end as inner_fold from e), "
    "m as (select d.*, st.id, c, y from st join d on st.grp = d.grp), k as materialized (select outer_fold, inner_fold, c, sum(y) as s, count(*) as n from m where not held group by 1, 2, 3), a as materialized (select outer_fold, inner_fold, sum(s) as s, sum(n) as n from k group by 1, 2), "
    "i as (select unnest(range(0, 6)) as inner_fold), cats as (select distinct c from st), outs as (select unnest(range(1, 6)) as outer_fold), "
    "base as (select outs.outer_fold, i.inner_fold, sum(a.s)/sum(a.n)::double as b from outs, i, a where a.outer_fold = outs.outer_fold and a.inner_fold <> i.inner_fold group by 1, 2), "
    "rate as (select base.outer_fold, base.inner_fold, cats.c, (coalesce(sum(k.s), 0) + any_value(b))/(coalesce(sum(k.n), 0) + 1) as p from base cross join cats left join k on k.outer_fold = base.outer_fold and k.c = cats.c and k.inner_fold <> base.inner_fold group by 1, 2, 3) "
)


@query("nested_rates", _NESTED + "select m.outer_fold::integer as outer_fold, id, grp as match_id, case when held then 'outer_heldout' else 'train_inner_oof' end as outer_role, m.inner_fold::integer as inner_fold, round(p, 6) as prediction from m join rate on m.outer_fold = rate.outer_fold and m.inner_fold = rate.inner_fold and m.c = rate.c")
def nested_rates(spark, sf_dir):
    """For every outer fold the chance that something follows, by the previous type: no row's own inner fold, nor the outer one, is in its rate."""
    rows = states(spark, sf_dir).select("event_id", "match_id", "previous_type", (F.col("remaining_xg") > 0).alias("y"))
    found = X.nested_rates(rows, "event_id", "match_id", "previous_type", "y")
    return found.select("outer_fold", "id", F.col("group").alias("match_id"), "outer_role", "inner_fold", F.round("prediction", 6).alias("prediction"))


@query("nested_expected_goals")
def nested_expected_goals(spark, sf_dir):
    """Labels of the first outer fold from logistic models; kept under a manifest in the shared folder."""
    rows = _rows(spark, sf_dir)
    place = folds(rows, "match_id", _FOLDS)
    fit = V.classifier(_COLUMNS, "value > 0", ridge=1e-3)
    path = f"{shared_folder(spark)}/nested-{uuid.uuid4().hex}"
    return X.nested_labels(rows, place.where("fold <> 1"), place.where("fold = 1"), "event_id", "match_id", fit, {"model": "logistic", "ridge": 1e-3}, path, inner=3)


# Temperature -------------------------------------------------------------------------------------------------------------

_MARGIN = f"select position_group as g, ln(0.98*expected_completion/(1 - 0.98*expected_completion)) as z, completed as y, count(*) as n from ({PASSES_SQL}) group by 1, 2, 3"
_P = "1/(1 + exp(-greatest(-35, least(35, z/{t}))))"
_LOSS = "-case when y = 1 then ln(greatest(1e-7, least(1 - 1e-7, {p}))) else ln(1 - greatest(1e-7, least(1 - 1e-7, {p}))) end"


def _temperature_sql() -> str:
    ctes = [f"d as materialized ({_MARGIN})", f"b0 as (select distinct g, ln({T.LOWEST}) as lo, ln({T.HIGHEST}) as hi from d)"]
    for i in range(T.ROUNDS):
        loss = _LOSS.format(p=_P.format(t="exp(t)"))
        ctes.append(f"l{i} as (select g, lo, hi, j, t, round(sum(n*({loss}))/sum(n), 12) as l from (select d.*, lo, hi, j, lo + (hi - lo)*j/{T.GRID - 1} as t from d join b{i} b on d.g = b.g, (select unnest(range({T.GRID})) as j)) group by 1, 2, 3, 4, 5)")
        ctes.append(f"m{i} as materialized (select *, (hi - lo)/{T.GRID - 1} as step from l{i} qualify row_number() over (partition by g order by l, j) = 1)")
        ctes.append(f"b{i + 1} as (select g, greatest(lo, lo + (j - 1)*step) as lo, least(hi, lo + (j + 1)*step) as hi from m{i})")
    ctes.append(f"fit as materialized (select g, exp(t) as temperature from m{T.ROUNDS - 1})")
    return ", ".join(ctes)


_RAW, _SCALED = _P.format(t="1.0"), _P.format(t="temperature")
_ASSESSED = (
    f", k as (select d.g, temperature, y, n, kind, case when kind = 'raw' then {_RAW} else {_SCALED} end as p from d join fit on d.g = fit.g, (values ('raw'), ('scaled')) v(kind)), "
    f"bins as (select g, temperature, kind, greatest(ceil(p*10), 1) as b, sum(n) as n, sum(n*({_LOSS.format(p='p')})) as l, sum(n*(p - y)*(p - y)) as q, sum(n*p) as sp, sum(n*y) as sy from k group by 1, 2, 3, 4), "
    "s as (select g, temperature, kind, sum(l)/sum(n) as log_loss, sum(q)/sum(n) as brier, sum(abs(sp - sy))/sum(n) as ece from bins group by 1, 2, 3), "
    "w as (select g, temperature, " + ", ".join(f"max({m}) filter (kind = '{k}') as {k}_{m}" for k in ("raw", "scaled") for m in ("log_loss", "brier", "ece")) + " from s group by 1, 2) "
)


def _margins(spark, sf_dir):
    p = F.col("expected_completion") * 0.98
    return views.actions(spark, sf_dir).select(F.col("position_group").alias("g"), F.log(p / (1 - p)).alias("z"), F.col("completed").alias("y"))


@query(
    "temperature_scaling",
    "with " + _temperature_sql() + _ASSESSED + "select g as position_group, round(temperature, 4) as temperature, " + ", ".join(f"round({k}_{m}, 6) as {k}_{m}" for k in ("raw", "scaled") for m in ("log_loss", "brier", "ece")) + ", "
    f"raw_log_loss - scaled_log_loss >= {T.LEAST_LOG_LOSS} and raw_brier - scaled_brier >= {T.LEAST_BRIER} and scaled_ece - raw_ece <= {T.MOST_ECE} as retained from w",
)
def temperature_scaling(spark, sf_dir):
    """The temperature of each position group, and whether its gain is worth keeping."""
    rows = _margins(spark, sf_dir)
    found = T.assessed(rows, "g", "z", "y", T.fit_temperature(rows, "g", "z", "y"))
    return found.select(F.col("g").alias("position_group"), F.round("temperature", 4).alias("temperature"), *[F.round(f"{k}_{m}", 6).alias(f"{k}_{m}") for k in ("raw", "scaled") for m in ("log_loss", "brier", "ece")], "retained")
