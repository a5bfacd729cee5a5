"""Registered queries on clusterings of style vectors: stability over seeds and resamples, alignment, internal quality, information criteria."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from touchline.operators import clustering as C
from touchline.plans.base import query
from touchline.plans.vectors import DIMS, STYLE_VECTORS_SQL, style_vectors
from touchline.sources.scratch import stored

SEEDS, RESAMPLES, SHARE, K, RESTARTS, ROUNDS = 25, 100, 0.8, 3, 3, 8

# The same fits in SQL ----------------------------------------------------------------------------------------------------

_D = " + ".join(f"(v[{i}] - c[{i}])*(v[{i}] - c[{i}])" for i in range(1, DIMS + 1))
_AVG = "list_value(" + ", ".join(f"avg(v[{i}])" for i in range(1, DIMS + 1)) + ")"


def _lloyd_sql(seeds: int, resamples: int, k: int = K, restarts: int = RESTARTS) -> str:
    """CTEs: e (fit, run, player_id, v), a (fit, run, player_id, label, d) after all rounds, c (fit, label, c), best (run, fit, inertia)."""
    drawn = f"select run, player_id, v from (select r.run, s.player_id, s.v, row_number() over (partition by r.run order by md5(r.run || ':' || s.player_id), s.player_id) as r, count(*) over (partition by r.run) as n from s, (select unnest(range({seeds}, {seeds + resamples})) as run) r) where r <= floor(n*{SHARE})"
    ctes = [
        f"s as materialized ({STYLE_VECTORS_SQL})",
        f"m as (select unnest(range({seeds})) as run, player_id, v from s" + (f" union all {drawn})" if resamples else ")"),
        f"e as materialized (select run*{restarts} + t as fit, run, player_id, v from m, (select unnest(range({restarts})) as t))",
        f"c0 as materialized (select fit, r - 1 as label, v as c from (select fit, v, row_number() over (partition by fit order by md5(fit || ':' || player_id), player_id) as r from e) where r <= {k})",
    ]
    near = "select e.fit, run, player_id, v, label, round({d}, 9) as d from e join {c} c on e.fit = c.fit qualify row_number() over (partition by e.fit, player_id order by round({d}, 9), label) = 1"
    for i in range(ROUNDS):
        ctes.append(f"a{i} as materialized ({near.format(d=_D, c=f'c{i}')})")
        ctes.append(f"c{i + 1} as materialized (select o.fit, o.label, coalesce(n.c, o.c) as c from c{i} o left join (select fit, label, {_AVG} as c from a{i} group by 1, 2) n on o.fit = n.fit and o.label = n.label)")
    ctes.append(f"a as materialized ({near.format(d=_D, c=f'c{ROUNDS}')})")
    ctes.append("best as materialized (select run, fit, inertia from (select run, fit, round(sum(d), 6) as inertia from a group by 1, 2) qualify row_number() over (partition by run order by inertia, fit) = 1)")
    ctes.append(f"base as (select fit from best where run < {seeds} order by inertia, fit limit 1)")
    order = ", ".join(f"round(c[{i}], 9)" for i in range(1, DIMS + 1))
    ctes.append(f"o as (select label, row_number() over (order by {order}) - 1 as reference from c{ROUNDS} where fit = (select fit from base))")
    ctes.append("ref as materialized (select player_id, v, reference from a join o on a.label = o.label where fit = (select fit from base))")
    return ", ".join(ctes)


_PERMUTATIONS = ", ".join(f"({p}, {i}, {a})" for p, order in enumerate(itertools.permutations(range(K))) for i, a in enumerate(order))
_STABILITY_SQL = (
    "with " + _lloyd_sql(SEEDS, RESAMPLES) + ", l as materialized (select a.run, a.player_id, a.label, reference from a join best on a.fit = best.fit join ref on a.player_id = ref.player_id), n as (select run, reference, label, count(*) as n from l group by 1, 2, 3), "
    f"p(p, label, aligned) as (values {_PERMUTATIONS}), g as (select run, p.p, sum(case when reference = aligned then n else 0 end) as agreed from n join p on n.label = p.label group by 1, 2), b as (select run, p from g qualify row_number() over (partition by run order by agreed desc, p) = 1), "
    "j as materialized (select l.run, player_id, reference, reference = aligned as same from l join b on l.run = b.run join p on b.p = p.p and l.label = p.label), "
    "x as (select n.run, sum(n*(n-1)/2) as both_ from n group by 1), y as (select run, sum(n*(n-1)/2) as r, sum(n)*(sum(n)-1)/2 as t from (select run, reference, sum(n) as n from n group by 1, 2) group by 1), z as (select run, sum(n*(n-1)/2) as c from (select run, label, sum(n) as n from n group by 1, 2) group by 1), "
    "ari as (select x.run, coalesce((both_ - r*c/t)/nullif((r + c)/2 - r*c/t, 0), 1) as ari from x join y on x.run = y.run join z on x.run = z.run) "
)
_KIND = f"case when run < {SEEDS} then 'seed' else 'resample' end"


def _fits(spark, sf_dir, seeds: int, resamples: int):
    rows = style_vectors(spark, sf_dir).select("player_id", "v")
    members = C.with_runs(rows, "player_id", "v", seeds, resamples, SHARE)
    return C.Fits(members, "player_id", K, RESTARTS, ROUNDS).labels(seeds)


def _kind():
    return F.when(F.col("run") < SEEDS, "seed").otherwise("resample")


@query("cluster_run_ari", _STABILITY_SQL + f"select {_KIND.replace('run', 'ari.run')} as kind, ari.run::integer as run, round(ari, 6) as ari, agreed.share from ari join (select run, round(avg(same::int), 6) as share from j group by 1) agreed on ari.run = agreed.run")
def cluster_run_ari(spark, sf_dir):
    """Agreement of every seed and resample with the reference clustering."""
    labels, reference = _fits(spark, sf_dir, SEEDS, RESAMPLES)
    ari = C.rand_indices(C.contingency(labels, reference, "player_id"))
    share = C.agreement(labels, reference, "player_id", K).groupBy("run").agg(F.round(F.avg(F.col("same").cast("int")), 6).alias("share"))
    return ari.join(share, "run").select(_kind().alias("kind"), "run", F.round("ari", 6).alias("ari"), "share")


@query("cluster_stability_summary", _STABILITY_SQL + f"select {_KIND} as kind, count(*) as runs, round(avg(ari), 6) as mean_ari, round(median(ari), 6) as median_ari, round(min(ari), 6) as minimum_ari from ari group by 1")
def cluster_stability_summary(spark, sf_dir):
    labels, reference = _fits(spark, sf_dir, SEEDS, RESAMPLES)
    ari = C.rand_indices(C.contingency(labels, reference, "player_id"))
    return ari.groupBy(_kind().alias("kind")).agg(
        F.count("*").alias("runs"), F.round(F.avg("ari"), 6).alias("mean_ari"), F.round(F.median("ari"), 6).alias("median_ari"), F.round(F.min("ari"), 6).alias("minimum_ari")
    )  # a row per run


@query("cluster_player_stability", _STABILITY_SQL + f"select ref.player_id, ref.reference::integer as cluster, count(j.run) as appearances, round(coalesce(avg(same::int), 0), 6) as stability from ref left join j on ref.player_id = j.player_id and j.run >= {SEEDS} group by 1, 2")
def cluster_player_stability(spark, sf_dir):
    """How often a player keeps its cluster among the resamples that drew it."""
    labels, reference = _fits(spark, sf_dir, SEEDS, RESAMPLES)
    same = C.agreement(labels.where(F.col("run") >= SEEDS), reference, "player_id", K).groupBy("player_id").agg(F.count("*").alias("n"), F.avg(F.col("same").cast("int")).alias("s"))
    return reference.join(same, "player_id", "left").select("player_id", F.col("reference").alias("cluster"), F.coalesce("n", F.lit(0)).alias("appearances"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("stability"))


@query("cluster_assignment_stability", _STABILITY_SQL + f"select reference::integer as cluster, count(*) as appearances, round(avg(same::int), 6) as stability from j where run >= {SEEDS} group by 1")
def cluster_assignment_stability(spark, sf_dir):
    labels, reference = _fits(spark, sf_dir, SEEDS, RESAMPLES)
    same = C.agreement(labels.where(F.col("run") >= SEEDS), reference, "player_id", K)
    return same.groupBy(F.col("reference").alias("cluster")).agg(F.count("*").alias("appearances"), F.round(F.avg(F.col("same").cast("int")), 6).alias("stability"))


# Internal quality of the reference clustering ----------------------------------------------------------------------------

_REF_SQL = "with " + _lloyd_sql(SEEDS, 0)
_VV = "sqrt(" + " + ".join(f"(a.v[{i}] - b.v[{i}])*(a.v[{i}] - b.v[{i}])" for i in range(1, DIMS + 1)) + ")"
_SILHOUETTE = (
    f", q as (select a.player_id, a.reference as own, b.reference as other, sum({_VV}) as total, count(*) as n from ref a, ref b group by 1, 2, 3), "
    "w as (select player_id, own, max(case when own = other then total/nullif(n - 1, 0) end) as a, min(case when own <> other then total/n end) as b from q group by 1, 2), "
    "sil as (select player_id, own, coalesce((b - a)/nullif(greatest(a, b), 0), 0) as s from w) "
)


def _reference(spark, sf_dir):
    _, reference = _fits(spark, sf_dir, SEEDS, 0)
    return stored(style_vectors(spark, sf_dir).select("player_id", "v").join(reference, "player_id"), "reference-clusters")


@query("cluster_silhouettes", _REF_SQL + _SILHOUETTE + "select player_id, own::integer as cluster, round(s, 6) as silhouette from sil")
def cluster_silhouettes(spark, sf_dir):
    found = C.silhouettes(_reference(spark, sf_dir), "player_id", "v", "reference")
    return found.select("player_id", F.col("reference").alias("cluster"), F.round("silhouette", 6).alias("silhouette"))


_CC = " + ".join(f"(a.c[{i}] - b.c[{i}])*(a.c[{i}] - b.c[{i}])" for i in range(1, DIMS + 1))
_VC = " + ".join(f"(ref.v[{i}] - k.c[{i}])*(ref.v[{i}] - k.c[{i}])" for i in range(1, DIMS + 1))
_MEAN = "list_value(" + ", ".join(f"avg(v[{i}])" for i in range(1, DIMS + 1)) + ")"


@query(
    "cluster_internal_metrics",
    _REF_SQL + _SILHOUETTE.rstrip() + f", k as (select reference as l, count(*) as n, {_MEAN} as c from ref group by 1), sp as (select l, avg(sqrt({_VC})) as s, any_value(k.c) as c from ref join k on reference = l group by 1), "
    f"db as (select avg(r) as db from (select a.l, max((a.s + b.s)/sqrt({_CC})) as r from sp a join sp b on a.l <> b.l group by 1)), whole as (select {_MEAN} as c from ref), bt as (select sum(a.n*({_CC})) as bt, count(*) as k, sum(a.n) as n from k a, whole b), wi as (select sum({_VC}) as wi from ref join k on reference = l) "
    "select n::bigint as players, k as clusters, (select round(avg(s), 6) from sil) as silhouette, (select round(db, 6) from db) as davies_bouldin, round((bt/(k - 1))/((select wi from wi)/(n - k)), 4) as calinski_harabasz from bt",
)
def cluster_internal_metrics(spark, sf_dir):
    rows = _reference(spark, sf_dir)
    size = rows.agg(F.count("*").alias("players"), F.countDistinct("reference").alias("clusters"))
    silhouette = C.silhouettes(rows, "player_id", "v", "reference").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))
    one = size.crossJoin(silhouette).crossJoin(C.davies_bouldin(rows, "v", "reference", DIMS)).crossJoin(C.calinski_harabasz(rows, "v", "reference", DIMS))  # one row each
    return one.select("players", "clusters", "silhouette", F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


# Mixtures: diagonal covariances have SQL, full ones are tested against numpy -----------------------------------------------

_EM_ROUNDS = 4


def _em_sql() -> str:
    moments = "sum(w) as w, list_value(" + ", ".join(f"sum(w*v[{i}])/sum(w)" for i in range(1, DIMS + 1)) + ") as m, list_value(" + ", ".join(f"sum(w*v[{i}]*v[{i}])/sum(w) - (sum(w*v[{i}])/sum(w))*(sum(w*v[{i}])/sum(w)) + 0.000001" for i in range(1, DIMS + 1)) + ") as q"
    log_p = "ln(w/t) - 0.5*(" + " + ".join(f"ln(2*pi()*q[{i}]) + (v[{i}] - m[{i}])*(v[{i}] - m[{i}])/q[{i}]" for i in range(1, DIMS + 1)) + ")"
    parts = ["r0 as materialized (select player_id, v, j, case when reference = j then 1.0 else 0.0 end as w from ref, (select unnest(range(3)) as j))"]
    for i in range(_EM_ROUNDS + 1):
        parts.append(f"p{i} as materialized (select j, {moments}, sum(sum(w)) over () as t from r{i} group by j)")
        parts.append(f"g{i} as materialized (select player_id, ref.v, j, {log_p.replace('v[', 'ref.v[')} as g from ref, p{i})")
        parts.append(f"s{i} as (select player_id, max(g) + ln(sum(exp(g - mx))) as lp from (select *, max(g) over (partition by player_id) as mx from g{i}) group by player_id)")
        parts.append(f"r{i + 1} as materialized (select g.player_id, v, j, exp(g - lp) as w from g{i} g join s{i} s on g.player_id = s.player_id)")
    return ", ".join(parts)


@query(
    "mixture_information",
    _REF_SQL + ", " + _em_sql() + f", f as (select count(*) as n, {K * 2 * DIMS + K - 1} as p, sum(lp) as ll from s{_EM_ROUNDS}) select n, p::integer as parameters, round(ll, 4) as log_likelihood, round(p*ln(n) - 2*ll, 4) as bic, round(2*p - 2*ll, 4) as aic from f",
)
def mixture_information(spark, sf_dir):
    """Likelihood and information criteria of a mixture with diagonal covariances, started from the reference clustering."""
    found = C.Mixture(_reference(spark, sf_dir), "v", "reference", K, DIMS, _EM_ROUNDS, full=False).information()
    return found.select("n", "parameters", *[F.round(c, 4).alias(c) for c in ("log_likelihood", "bic", "aic")])
