"""Registered queries on raw files: payloads made of the events table and read back, choice of seasons, chronology."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.plans.base import query
from touchline.plans.sequences import POSSESSIONS_SQL, possessions
from touchline.session import table
from touchline.sources import raw_matches as R


def _files(spark, sf_dir):
    """(match_id, payload): events of even matches as a list, of odd ones as a map by id; every third event lacks its outcome."""
    e = possessions(spark, sf_dir)
    named = lambda i, n: F.struct(i.cast("long").alias("id"), n.alias("name"))
    outcome = F.when(F.col("event_id") % 3 > 0, named(F.lit(9), F.lit("Incomplete")))
    event = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"), F.col("event_index").cast("long").alias("index"), F.col("match_id"), named(F.lit(30), F.col("event_type")).alias("type"), F.col("possession_id").cast("long").alias("possession"), named(F.col("team_id"), F.concat(F.lit("T"), F.col("team_id").cast("string"))).alias("team"),
            F.array(F.col("value"), F.when(F.col("event_id") % 5 > 0, F.col("value") / 2)).alias("location"), F.struct(F.array(F.col("value") / 4, F.lit(3.0)).alias("end_location"), outcome.alias("outcome"), F.col("value").alias("length")).alias("pass"), F.when(F.col("event_id") % 7 == 0, True).alias("under_pressure"),
        )
    )
    member = F.when(F.col("match_id") % 2 == 0, event).otherwise(F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('": '), event))
    held = e.select("match_id", "event_index", member.alias("m")).groupBy("match_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_index", "m"))), lambda x: x["m"]), ", ").alias("body"))  # one match
    around = lambda a, b: F.concat(F.lit(a), F.col("body"), F.lit(b))
    return held.select("match_id", F.when(F.col("match_id") % 2 == 0, around("[", ", 5, null]")).otherwise(around("{", ', "note": "text"}')).alias("payload"))


@query(
    "payload_passes",
    f"select match_id, team_id, 'T' || team_id as team_name, round(case when event_id % 5 > 0 then value end, 4) as start_x, round(case when event_id % 5 > 0 then value/2 end, 4) as start_y, round(value/4, 4) as end_x, round(value, 4) as pass_length, event_id % 7 = 0 as under_pressure, case when event_id % 3 > 0 then 'Incomplete' end as pass_outcome, case when event_id % 3 > 0 then 0 else 1 end as completed from ({POSSESSIONS_SQL}) where event_type = 'Pass'",
)
def payload_passes(spark, sf_dir):
    """Passes of payloads in both shapes."""
    p = R.pass_table(R.payload_events(_files(spark, sf_dir)))
    return p.select("match_id", "team_id", "team_name", *[F.round(c, 4).alias(c) for c in ("start_x", "start_y", "end_x", "pass_length")], "under_pressure", "pass_outcome", "completed")


_CATALOGUE = "select distinct n_nationkey as competition_id, year(o_orderdate)*10 + o_custkey % 2 as season_id, r_name as country_name, n_name as competition_name, case o_custkey % 2 when 0 then year(o_orderdate) || '/' || lpad(((year(o_orderdate) + 1) % 100)::varchar, 2, '0') else year(o_orderdate) || '-' || (year(o_orderdate) + 1) end as season_name, case n_nationkey % 5 when 0 then 'female' else 'Male' end as competition_gender from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where not (n_nationkey % 3 = 0 and year(o_orderdate) = 1996)"


@query(
    "season_choice",
    f"with c as ({_CATALOGUE}), s as (select *, string_split(replace(season_name, '-', '/'), '/')[1]::int as a, string_split(replace(season_name, '-', '/'), '/')[2]::int as b from c where lower(competition_gender) = 'male'), t as (select *, a || '/' || case when b < 100 then a // 100 * 100 + b else b end as season from s) "
    "select competition_id, season_id, competition_name, season from t qualify row_number() over (partition by competition_id order by (season = '1996/1997') desc, a desc, season_id) = 1",
)
def season_choice(spark, sf_dir):
    """The preferred season of each competition, else its newest."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    y = F.year("o_orderdate")
    short = F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).where(~((F.col("n_nationkey") % 3 == 0) & (y == 1996)))
    catalogue = rows.select(
        F.col("n_nationkey").alias("competition_id"), (y * 10 + F.col("o_custkey") % 2).alias("season_id"), F.col("r_name").alias("country_name"), F.col("n_name").alias("competition_name"),
        F.when(F.col("o_custkey") % 2 == 0, short).otherwise(F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))).alias("season_name"), F.when(F.col("n_nationkey") % 5 == 0, "female").otherwise("Male").alias("competition_gender"),
    ).distinct()
    return R.newest_or_preferred(catalogue, "1996/1997").select("competition_id", "season_id", "competition_name", R.season(F.col("season_name")).alias("season"))


@query("chronology", "select o_orderkey as match_id, o_orderdate::date as match_date, row_number() over (order by o_orderdate::date, o_orderpriority, o_orderkey) - 1 as ordinal from orders where lower(o_orderstatus) = 'f'")
def chronology(spark, sf_dir):
    """Available matches in the order of date, kick-off (here: priority) and id."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("match_date"), F.col("o_orderpriority").alias("kick_off"), F.when(F.col("o_orderstatus") == "F", "Available").otherwise("deleted").alias("match_status"))
    return R.chronology(o, R.available_matches(o)).select("match_id", "match_date", "ordinal")
