"""Registered serving, join, set, text and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.plans.base import query
from touchline.plans.profiles import ATTACKING_SQL, FEATURES_SQL, PROFILE_SQL, SHOOTING_SQL, attacking_profile, features, passing_profile, shooting_profile
from touchline.plans.sequences import HALVES_SQL  # noqa: F401
from touchline.sources import views
from touchline.sources.views import PASSES_SQL, SHOTS_SQL


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BOARD = "select player_id, {m}, row_number() over (order by {m} desc, player_id)::integer as rank from ({q}) where {g} and {m} is not null qualify rank <= 25"


@query("leaderboard_completion", _BOARD.format(m="all_above_expected_pp", q=PROFILE_SQL, g="all_attempts >= 100"))
def leaderboard_completion(spark, sf_dir):
    board = X.leaderboard(passing_profile(spark, sf_dir), "all_above_expected_pp", gate=F.col("all_attempts") >= 100)
    return board.select("player_id", "all_above_expected_pp", "rank")


@query("leaderboard_attacking", _BOARD.format(m="all_per_100", q=ATTACKING_SQL, g="reliable"))
def leaderboard_attacking(spark, sf_dir):
    return X.leaderboard(attacking_profile(spark, sf_dir), "all_per_100", gate=F.col("reliable")).select("player_id", "all_per_100", "rank")


@query("player_search_page", "select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' order by c_acctbal desc nulls last, c_custkey limit 20 offset 20")
def player_search_page(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    return X.page(rows, "c_acctbal", "c_custkey", 20, 20, allowed=("c_acctbal", "c_name"))


UNIFIED_SQL = f"with p as ({PROFILE_SQL}), s as ({SHOOTING_SQL}), a as ({ATTACKING_SQL}) select p.player_id, p.all_attempts, coalesce(s.shots, 0) as shots, coalesce(s.goals, 0) as goals, coalesce(s.total_xg, 0) as total_xg, s.xg_per_shot, coalesce(s.reliable, false) as shooting_reliable, a.all_per_100, a.reliable as attacking_reliable from p left join s on p.player_id = s.player_id left join a on p.player_id = a.player_id"


@query("player_profile", UNIFIED_SQL)
def player_profile(spark, sf_dir):
    """Passing, shooting and attacking side by side: counts become 0 where missing, rates stay null, flags false."""
    p = passing_profile(spark, sf_dir).select("player_id", "all_attempts")
    s = shooting_profile(spark, sf_dir).select("player_id", "shots", "goals", "total_xg", "xg_per_shot", F.col("reliable").alias("shooting_reliable"))
    a = attacking_profile(spark, sf_dir).select("player_id", "all_per_100", F.col("reliable").alias("attacking_reliable"))
    return p.join(s, "player_id", "left").join(a, "player_id", "left").fillna({"shots": 0, "goals": 0, "total_xg": 0.0, "shooting_reliable": False})


_ACTIONS_PAGE = "select order_key, match_number, action_type, round(attacking_value, 6) as attacking_value from ({s}) where player_id = 3 and progressive order by attacking_value desc, order_key, match_number, action_type, start_x limit 50"


@query("player_actions_page", _ACTIONS_PAGE.format(s=FEATURES_SQL))
def player_actions_page(spark, sf_dir):
    rows = features(spark, sf_dir).where("player_id = 3 and progressive").withColumn("attacking_value", F.round("attacking_value", 6))
    top = rows.orderBy(F.desc("attacking_value"), "order_key", "match_number", "action_type", "start_x").limit(50)  # by the values shown
    return top.select("order_key", "match_number", "action_type", "attacking_value")


@query("passes_with_value", f"select player_id, count(*) as passes, count(v) as with_orders, round(avg(v), 6) as mean_price from (select player_id, o_totalprice as v from ({PASSES_SQL}) p left join orders on p.order_key = o_orderkey and o_orderstatus = 'F') group by 1")
def passes_with_value(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("v"))
    joined = views.passes(spark, sf_dir).select("player_id", "order_key").join(orders, "order_key", "left")
    return joined.groupBy("player_id").agg(F.count("*").alias("passes"), F.count("v").alias("with_orders"), F.round(F.avg("v"), 6).alias("mean_price"))


@query("compare_two", f"select player_id, all_attempts, all_rate, case player_id when 7 then 0 else 1 end as place from ({PROFILE_SQL}) where player_id in (7, 2)")
def compare_two(spark, sf_dir):
    return X.in_order(passing_profile(spark, sf_dir).select("player_id", "all_attempts", "all_rate"), "player_id", [7, 2])


@query("meta", f"select count(distinct match_id) as matches, count(distinct player_id) as players, count(distinct team_id) as teams, count(*) as actions, array_to_string(list_sort(list(distinct position_group)), ',') as groups from ({PASSES_SQL})")
def meta(spark, sf_dir):
    return views.passes(spark, sf_dir).agg(
        F.countDistinct("match_id").alias("matches"), F.countDistinct("player_id").alias("players"), F.countDistinct("team_id").alias("teams"), F.count("*").alias("actions"), F.array_join(F.array_sort(F.collect_set("position_group")), ",").alias("groups"),
    )


@query("autocomplete_rank", "select n_nationkey, n_name, relevance from (select *, case when starts_with(lower(n_name), 'na') then 0 when contains(lower(n_name), ' na') then 1 when contains(lower(n_name), 'na') then 2 end as relevance from nation) where relevance is not null order by relevance, n_name, n_nationkey limit 10")
def autocomplete_rank(spark, sf_dir):
    return X.autocomplete(_read(spark, sf_dir, "nation"), "n_name", "n_nationkey", "na").select("n_nationkey", "n_name", "relevance")


@query(
    "name_match_classes",
    "with k as (select c_custkey, c_name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as n from customer), m as (select *, case when n = 'customer 000000017' then 1 when contains(n, 'customer 000000017') then 2 when len(list_filter(['customer', '000000017'], lambda x: not list_contains(string_split(n, ' '), x))) = 0 then 3 end as match_class from k) select c_custkey, match_class from m where match_class = (select min(match_class) from m)",
)
def name_match_classes(spark, sf_dir):
    return X.name_matches(_read(spark, sf_dir, "customer"), "c_name", "Customer#000000017").select("c_custkey", "match_class")


_FOLDS = "select match_id, ((row_number() over (order by md5(match_id::varchar), match_id) - 1) % 5 + 1)::integer as fold from (select distinct match_id from ({s}))"


@query("grouped_folds", _FOLDS.format(s=PASSES_SQL))
def grouped_folds(spark, sf_dir):
    return X.folds(views.actions(spark, sf_dir), "match_id", 5)


@query("oof_group_mean", f"with f as ({_FOLDS.format(s=PASSES_SQL)}), p as (select p.player_id, f.fold, completed from ({PASSES_SQL}) p join f on p.match_id = f.match_id), t as (select player_id, fold, sum(completed) as s, count(*) as n from p group by 1, 2) select player_id, fold, round((sum(s) over w - s)/nullif(sum(n) over w - n, 0)::double, 6) as rate from t window w as (partition by player_id)")
def oof_group_mean(spark, sf_dir):
    """A player's completion rate outside each fold: cross-fitted, no row sees its own fold."""
    from pyspark.sql import Window

    rows = views.actions(spark, sf_dir).select("match_id", "player_id", "completed")
    each = rows.groupBy("player_id", "match_id").agg(F.sum("completed").alias("s"), F.count("*").alias("n"))
    per = each.join(X.folds(rows, "match_id", 5), "match_id").groupBy("player_id", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    w = Window.partitionBy("player_id")
    return per.select("player_id", "fold", F.round(P.rate(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), 6).alias("rate"))


@query("match_resamples", f"with g as (select distinct match_id from ({PASSES_SQL})), r as (select match_id, resample::integer as resample, row_number() over (partition by resample order by md5(resample || ':' || match_id), match_id) as r, count(*) over (partition by resample) as n from g, range(20) t(resample)) select match_id, resample from r where r <= round(n*0.8)")
def match_resamples(spark, sf_dir):
    return X.resamples(views.passes(spark, sf_dir), "match_id", 20)


@query("leave_one_match_out", f"with t as (select team_id, match_id, count(*) as n, sum(attacking_value) as v from ({PASSES_SQL}) group by 1, 2) select team_id, match_id as without_match_id, cast(sum(n) over w - n as bigint) as n, round(sum(v) over w - v, 6) as attacking_value from t window w as (partition by team_id)")
def leave_one_match_out(spark, sf_dir):
    return X.leave_one_out(views.passes(spark, sf_dir), ["team_id"], "match_id", ["attacking_value"])


@query("semi_filter", "select o_orderstatus, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by 1")
def semi_filter(spark, sf_dir):
    kept = _read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return _read(spark, sf_dir, "orders").join(kept, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("anti_orphans", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_orphans(spark, sf_dir):
    customer, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("union_distinct_pairs", f"select player_id, match_id from ({PASSES_SQL}) where under_pressure union select player_id, match_id from ({SHOTS_SQL})")
def union_distinct_pairs(spark, sf_dir):
    pairs = views.passes(spark, sf_dir).where("under_pressure").select("player_id", "match_id")
    return pairs.unionByName(views.shots(spark, sf_dir).select("player_id", "match_id")).distinct()


@query("json_props_extract", "select event_type, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def json_props_extract(spark, sf_dir):
    parsed = F.from_json("props", "k long")["k"]
    return _read(spark, sf_dir, "events").groupBy("event_type", parsed.alias("k")).agg(F.count("*").alias("n"))


_QUALITY = "case when url like 'https://%' then 2 else 1 end"


@query(
    "url_dedupe_select",
    f"with u as (select page_id, regexp_replace(url, '/+$', '') as plain_url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, {_QUALITY} as quality from pages), a as (select *, row_number() over (partition by plain_url order by quality desc, plain_url, page_id) as r from u), b as (select *, row_number() over (partition by host order by quality desc, plain_url, page_id) as q from a where r = 1) select page_id, host, plain_url from b where q = 1",
)
def url_dedupe_select(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", "url")
    quality = F.when(F.startswith("url", F.lit("https://")), 2).otherwise(1)
    return X.one_per_url_and_host(rows, "url", "page_id", quality).select("page_id", "host", "plain_url")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www[.]', '')"


def _in_domains(domains) -> str:
    return " or ".join(f"h = '{d}' or h like '%.{d}'" for d in domains)


@query("source_quality", f"select page_id, case when {_in_domains(T.OFFICIAL_DOMAINS)} then 'official' when {_in_domains(T.REPUTABLE_DOMAINS)} then 'reputable_media' else 'other' end as quality from (select page_id, {_HOST} as h from (select page_id, case page_id % 6 when 0 then 'https://www.uefa.com/a' when 1 then 'http://Sport.BBC.com' when 2 then 'http://notuefa.com/x' else url end as url from pages))")
def source_quality(spark, sf_dir):
    """Class of each page's host; some hosts are exchanged for known ones, so that every class occurs."""
    url = F.when(F.col("page_id") % 6 == 0, "https://www.uefa.com/a").when(F.col("page_id") % 6 == 1, "http://Sport.BBC.com").when(F.col("page_id") % 6 == 2, "http://notuefa.com/x").otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", T.source_quality(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)).alias("quality"))


@query("control_char_clean", r"select doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'))::integer as n from documents")
def control_char_clean(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(T.without_controls(F.col("text"))).alias("n"))


_CITED = "'see [evidence_' || source || '; ' || lang || '-evidence] and [evidence' || doc_id || ' ;evidence' || doc_id || '] not [evidence ' || lang || '; x] nor [y]'"


@query(
    "citation_extract",
    rf"select doc_id, array_to_string(flatten(list_filter(list_transform(regexp_extract_all(t, '\[([^\[\]]+)\]', 1), lambda g: list_transform(string_split(g, ';'), lambda x: trim(x))), lambda m: len(list_filter(m, lambda x: not regexp_full_match(x, '\S*[eE][vV][iI][dD][eE][nN][cC][eE]\S*'))) = 0)), ',') as ids from (select doc_id, {_CITED} as t from documents)",
)
def citation_extract(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.citation_ids(F.expr(_CITED)), ",").alias("ids"))


@query("category_normalise", "select coalesce(nullif(trim(case when o_orderkey % 5 = 0 then '  ' when o_orderkey % 7 = 0 then null else ' ' || o_orderpriority end), ''), 'Unknown') as category, count(*) as n from orders group by 1")
def category_normalise(spark, sf_dir):
    raw = F.expr("case when o_orderkey % 5 = 0 then '  ' when o_orderkey % 7 = 0 then null else concat(' ', o_orderpriority) end")
    return _read(spark, sf_dir, "orders").groupBy(T.category(raw, "Unknown").alias("category")).agg(F.count("*").alias("n"))


@query("clock_seconds", "select event_id, round(hour(ts)*3600 + minute(ts)*60 + second(ts) + (microsecond(ts) % 1000000)/1000000.0, 3)::double as seconds from events")
def clock_seconds(spark, sf_dir):
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    return _read(spark, sf_dir, "events").select("event_id", F.round(T.clock_seconds(clock), 3).alias("seconds"))


@query(
    "trace_summary",
    "select role, count(*) as turns, count(distinct conv_id) as conversations, round(avg(length(text)), 6) as mean_length, quantile_disc(length(text), 0.95)::integer as p95_length, case when count(*) = count(text) then cast(sum(length(text)) as bigint) end as total_length from conversations group by 1",
)
def trace_summary(spark, sf_dir):
    n = _read(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return n.groupBy("role").agg(
        F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg("n"), 6).alias("mean_length"),
        F.expr("percentile_disc(0.95) within group (order by n)").cast("int").alias("p95_length"), F.when(F.count("*") == F.count("text"), F.sum("n")).alias("total_length"),
    )


@query("nearest_rank_p95", "select event_type, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.5) as p50 from events group by 1")
def nearest_rank_p95(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(disc(0.95).alias("p95"), disc(0.5).alias("p50"))


@query("complete_sum", "select user_id % 10 as cohort, case when count(*) = count(v) then round(sum(v), 6) end as total from (select user_id, case when event_type = 'error' and user_id % 3 = 0 then null else value end as v from events) group by 1")
def complete_sum(spark, sf_dir):
    v = F.expr("case when event_type = 'error' and user_id % 3 = 0 then null else value end")
    rows = _read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cohort"), v.alias("v"))
    return rows.groupBy("cohort").agg(F.when(F.count("*") == F.count("v"), F.round(F.sum("v"), 6)).alias("total"))
