"""Registered queries on sequences and on sources matched by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import alignment as A
from touchline.operators import padding as D
from touchline.plans.base import query
from touchline.plans.sequences import POSSESSIONS_SQL, STATES_SQL, possessions, states

# Padded possessions ------------------------------------------------------------------------------------------------------

_BATCH = 16
_STATE = "select event_id, match_id, possession_id, event_index, case when event_id % 13 = 0 then null else action_number::double end as x1, elapsed_s::double as x2, case when event_id % 17 = 0 then null else (event_type = previous_type)::int end as b1, case when event_id % 19 = 0 then null else previous_type end as c1, event_type as c2, remaining_xg as y, match_id % 5 <> 0 and event_type <> 'Own Goal For' as train from ({s})"
_NUM = "with s as materialized ({state}), m as (select median(x1) as m1, median(x2) as m2 from s where train), f as (select s.*, coalesce(x1, m1) as f1, coalesce(x2, m2) as f2 from s, m), z as (select avg(f1) as a1, avg(f2) as a2, case when stddev_pop(f1) < 1e-8 then 1 else stddev_pop(f1) end as s1, case when stddev_pop(f2) < 1e-8 then 1 else stddev_pop(f2) end as s2, case when sum(b1) > count(b1)/2.0 then 1 else 0 end as mode from f where train), v1 as (select c1 as v, row_number() over (order by c1) as i from (select distinct c1 from s where train and c1 is not null)), v2 as (select c2 as v, row_number() over (order by c2) as i from (select distinct c2 from s where train))"


@query(
    "possession_sequences",
    _NUM.format(state=_STATE.format(s=STATES_SQL))
    + ", e as (select match_id, possession_id, event_index, event_id, round((f1 - a1)/s1, 3) as u1, round((f2 - a2)/s2, 3) as u2, coalesce(b1, mode) as b, coalesce(v1.i, 0) as k1, coalesce(v2.i, 0) as k2, y from f cross join z left join v1 on f.c1 = v1.v left join v2 on f.c2 = v2.v), "
    "p as (select match_id, possession_id, count(*) as length, sum(u1) as s1, sum(u2) as s2, sum(b)::bigint as flags, string_agg(k1 || ':' || k2, ' ' order by event_index) as codes, string_agg(event_id::varchar, ' ' order by event_index) as ids, sum(y) as target from e group by 1, 2), "
    f"o as (select *, floor((row_number() over (order by match_id, possession_id) - 1)/{_BATCH})::bigint as batch from p), w as (select *, max(length) over (partition by batch) as width from o) "
    "select match_id, possession_id, batch, length::integer as length, width::integer as width, repeat('1', length::integer) || repeat('0', (width - length)::integer) as mask, codes || repeat(' 0:0', (width - length)::integer) as codes, ids, flags, round(s1, 3) as continuous_1, round(s2, 3) as continuous_2, round(target, 6) as target from w",
)
def possession_sequences(spark, sf_dir):
    """Encoded and padded possessions; statistics and vocabularies come from four fifths of the matches, without one event type."""
    lost = lambda k, c: F.when(F.col("event_id") % k == 0, None).otherwise(c)
    s = states(spark, sf_dir).select(
        "event_id", "match_id", "possession_id", "event_index", lost(13, F.col("action_number")).alias("x1"), F.col("elapsed_s").alias("x2"), lost(17, F.col("event_type") == F.col("previous_type")).alias("b1"),
        lost(19, F.col("previous_type")).alias("c1"), F.col("event_type").alias("c2"), F.col("remaining_xg").alias("y"),
    )
    encoder = D.Encoder(["x1", "x2"], ["b1"], ["c1", "c2"]).fit(s.where((F.col("match_id") % 5 != 0) & (F.col("c2") != "Own Goal For")))
    found = D.padded(D.sequences(encoder.encode(s), ["match_id", "possession_id"], "event_index", "event_id", "y"), ["match_id", "possession_id"], _BATCH)
    total = lambda x: F.aggregate("steps", F.lit(0.0), lambda a, t: a + x(t))
    real = lambda x, i: F.aggregate(F.slice("steps", 1, F.col("length")), F.lit(0.0), lambda a, t: a + F.round(F.get(t[x], F.lit(i)), 3))
    return found.select(
        "match_id", F.col("possession_id").cast("long").alias("possession_id"), "batch", "length", "width",
        F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask"),
        F.array_join(F.transform("steps", lambda t: F.array_join(F.transform(t["categorical"], lambda c: c.cast("string")), ":")), " ").alias("codes"),
        F.array_join(F.transform("steps", lambda t: t["id"].cast("string")), " ").alias("ids"), real("binary", 0).cast("long").alias("flags"),
        F.round(real("continuous", 0), 3).alias("continuous_1"), F.round(real("continuous", 1), 3).alias("continuous_2"), F.round(total(lambda t: t["target"]), 6).alias("target"),
    )


# Sources matched by position ---------------------------------------------------------------------------------------------

_PASSES = f"select event_id, match_id, event_index, team_id, value from ({POSSESSIONS_SQL}) where event_type = 'Pass'"


def _passes(spark, sf_dir):
    return possessions(spark, sf_dir).where("event_type = 'Pass'").select("event_id", "match_id", "event_index", "team_id", "value")


@query("passes_by_ordinal", f"select event_id, row_number() over (order by match_id, event_index) - 1 as pass_index, round(value/1000, 6) as expected from ({_PASSES})")
def passes_by_ordinal(spark, sf_dir):
    """Events get the prediction of the same place in their match; predictions are numbered over all matches. Teams and values prove the match."""
    events = A.with_group_ordinal(_passes(spark, sf_dir), "match_id", ["event_index"])
    numbered = A.with_global_ordinal(_passes(spark, sf_dir).withColumn("expected", F.col("value") / 1000).drop("event_id"), ["match_id", "event_index"], "pass_index")
    predictions = A.with_group_ordinal(numbered, "match_id", ["pass_index"]).drop("event_index")
    found = A.aligned(events.drop("event_index"), predictions, ["match_id", "ordinal"], ["team_id"], ["value"])
    return found.select(F.col("left_event_id").alias("event_id"), F.col("right_pass_index").alias("pass_index"), F.round("right_expected", 6).alias("expected"))


@query(
    "alignment_audit",
    f"with p as ({_PASSES}), l as (select match_id, row_number() over (partition by match_id order by event_index) - 1 as o, team_id, value from p), r as (select match_id, row_number() over (partition by match_id order by event_index + case when event_id % 97 = 0 then 1.5 else 0 end) - 1 as o, team_id, value * (case when event_id % 89 = 0 then 1.0001 else 1.0000001 end) as value from p where event_id % 401 <> 0), "
    "j as (select l.match_id as lm, r.match_id as rm, l.team_id as lt, r.team_id as rt, l.value as lv, r.value as rv from l full join r on l.match_id = r.match_id and l.o = r.o) "
    "select 'only on the left' as problem, count(*) as rows from j where rm is null having count(*) > 0 union all select 'only on the right', count(*) from j where lm is null having count(*) > 0 union all select 'team_id', count(*) from j where lm is not null and rm is not null and lt <> rt having count(*) > 0 union all select 'value', count(*) from j where lm is not null and rm is not null and abs(lv - rv) > 1e-8 + 1e-5*abs(rv) having count(*) > 0",
)
def alignment_audit(spark, sf_dir):
    """What the proof finds where predictions were swapped, lost, or changed by more than the tolerance."""
    p = _passes(spark, sf_dir)
    left = A.with_group_ordinal(p, "match_id", ["event_index"]).select("match_id", "ordinal", "team_id", "value")
    moved = p.where("event_id % 401 <> 0").withColumn("at", F.col("event_index") + F.when(F.col("event_id") % 97 == 0, 1.5).otherwise(0.0))
    moved = moved.withColumn("value", F.col("value") * F.when(F.col("event_id") % 89 == 0, 1.0001).otherwise(1.0000001))
    right = A.with_group_ordinal(moved, "match_id", ["at"]).select("match_id", "ordinal", "team_id", "value")
    return A.alignment_report(A.matched(left, right, ["match_id", "ordinal"], ["team_id"], ["value"]))
