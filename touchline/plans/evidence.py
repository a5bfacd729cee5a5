"""Registered queries on the freshness that questions ask for, and on the evidence that answers select."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.dates import MONTHS, published_since
from touchline.operators import evidence as E
from touchline.plans.base import query
from touchline.session import table

_ASK = "case i % 11 when 0 then 'What happened in the last ' || (i % 4000) || ' days?' when 1 then 'Anything since ' || (2000 + i % 90) || '-' || (1 + i % 13) || '-' || (1 + i % 31) || ' please' when 2 then 'Since ' || ['January', 'MARCH', 'december', 'June'][1 + i % 4] || ' ' || (1 + i % 31) when 3 then 'all since february ' || (1 + i % 30) || ', ' || (2015 + i % 10) || ' on it' when 4 then 'over the past month' when 5 then 'news about player ' || i || ' from ' || (2000 + i % 99) when 6 then 'News in 2021' when 7 then 'the last days' when 8 then 'in the past 5 day and since 2020-01-01' else 'style of player ' || i end"
_TODAY = "date '2024-03-15' + (i % 400)::integer"


def _questions(spark, sf_dir):
    i = F.col("i")
    t = lambda x: x.cast("string")
    k = i % 11
    text = (
        F.when(k == 0, F.concat(F.lit("What happened in the last "), t(i % 4000), F.lit(" days?")))
        .when(k == 1, F.concat(F.lit("Anything since "), t(2000 + i % 90), F.lit("-"), t(1 + i % 13), F.lit("-"), t(1 + i % 31), F.lit(" please")))
        .when(k == 2, F.concat(F.lit("Since "), F.get(F.array(*[F.lit(m) for m in ("January", "MARCH", "december", "June")]), (i % 4).cast("int")), F.lit(" "), t(1 + i % 31)))
        .when(k == 3, F.concat(F.lit("all since february "), t(1 + i % 30), F.lit(", "), t(2015 + i % 10), F.lit(" on it")))
        .when(k == 4, "over the past month")
        .when(k == 5, F.concat(F.lit("news about player "), t(i), F.lit(" from "), t(2000 + i % 99)))
        .when(k == 6, "News in 2021")
        .when(k == 7, "the last days")
        .when(k == 8, "in the past 5 day and since 2020-01-01")
        .otherwise(F.concat(F.lit("style of player "), t(i)))
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    return rows.select("i", text.alias("question"), F.date_add(F.lit("2024-03-15").cast("date"), (i % 400).cast("int")).alias("today"))


_NAMED = f"(?i)\\bsince\\s+({'|'.join(MONTHS)})\\s+([0-9]{{1,2}})(,?\\s+(20[0-9]{{2}}))?\\b"
_ISO = "\\bsince\\s+(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})\\b"
_DAYS = "(?i)\\b(?:last|past)\\s+([0-9]{1,4})\\s+days?\\b"
_MON = "list_position([" + ", ".join(f"'{m}'" for m in MONTHS) + f"], lower(regexp_extract(q, '{_NAMED}', 1)))"


@query(
    "freshness_windows",
    f"with q as (select i, {_ASK} as q, {_TODAY} as today from (select c_custkey as i from customer)), p as (select *, try_cast(regexp_extract(q, '{_DAYS}', 1) as int) as days, {_MON} as mon, regexp_extract(q, '{_NAMED}', 2) as dom, regexp_extract(q, '{_NAMED}', 4) as yr from q), "
    "n as (select *, try_cast(year(today) || '-' || mon || '-' || dom as date) as d0, try_cast((year(today) - 1) || '-' || mon || '-' || dom as date) as d1, try_cast(yr || '-' || mon || '-' || dom as date) as d2 from p) "
    f"select i as question_id, case when days between 1 and 3650 then today - days when regexp_matches(q, '(?i)\\b(last|past)\\s+month\\b') then today - 30 when regexp_matches(q, '{_ISO}') then try_cast(regexp_extract(q, '{_ISO}', 1) || '-' || regexp_extract(q, '{_ISO}', 2) || '-' || regexp_extract(q, '{_ISO}', 3) as date) "
    "when mon is not null then case when yr <> '' then d2 when d0 > today then d1 else d0 end when regexp_matches(q, '(?i)\\bnews(\\s+(on|about)\\s+.+?)?\\s+(from|in)\\s+(20[0-9]{2})\\b') then try_cast(regexp_extract(q, '(?i)\\bnews(\\s+(on|about)\\s+.+?)?\\s+(from|in)\\s+(20[0-9]{2})\\b', 4) || '-01-01' as date) end as since from n",
)
def freshness_windows(spark, sf_dir):
    """From which day on each question wants its news."""
    return _questions(spark, sf_dir).select(F.col("i").alias("question_id"), published_since(F.col("question"), F.col("today")).alias("since"))


@query(
    "selected_evidence",
    "with r as (select conv_id, turn, role || '-evidence-' || turn as id, case turn % 4 when 0 then 'web' when 1 then 'analytics' when 2 then 'methodology' else 'other' end as category, case when turn % 5 = 2 then 'failed' else 'success' end as status, case when turn % 3 = 0 then ['  small sample' || chr(7), 'turn ' || (turn % 2)] when turn % 3 = 1 then ['', 'small sample'] else [] end as warnings from conversations), "
    "k as (select *, list_position(['analytics', 'methodology', 'web'], category) as place from r where status = 'success' and category <> 'other'), w as (select conv_id, -1 as place, 0 as turn, 0 as j, 'one league' as w from r where conv_id % 2 = 0 union select conv_id, place, turn, j, trim(replace(warnings[j], chr(7), '')) from (select *, unnest(range(1, len(warnings) + 1)) as j from k)), "
    "f as (select * from w where w <> '' qualify row_number() over (partition by conv_id, w order by place, turn, j) = 1), o as (select conv_id, string_agg(w, '|' order by place, turn, j) as warnings from f group by 1) "
    "select c.conv_id, coalesce(string_agg(id, ' ' order by k.turn) filter (category = 'analytics'), '') as analytics, coalesce(string_agg(id, ' ' order by k.turn) filter (category = 'methodology'), '') as methodology, coalesce(string_agg(id, ' ' order by k.turn) filter (category = 'web'), '') as web, coalesce(any_value(o.warnings), '') as warnings, case when count(id) > 0 then 'sufficient' else 'insufficient' end as status from (select distinct conv_id from conversations) c left join k on c.conv_id = k.conv_id left join o on c.conv_id = o.conv_id group by 1",
)
def selected_evidence(spark, sf_dir):
    """Successful records of each conversation by category, with their warnings once each."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    few = lambda *x: F.array(*x).cast("array<string>")
    records = c.select(
        "conv_id", turn.alias("at"), F.concat("role", F.lit("-evidence-"), turn.cast("string")).alias("evidence_id"), F.when(turn % 4 == 0, "web").when(turn % 4 == 1, "analytics").when(turn % 4 == 2, "methodology").otherwise("other").alias("category"),
        F.when(turn % 5 == 2, "failed").otherwise("success").alias("status"), F.when(turn % 3 == 0, few(F.lit("  small sample\x07"), F.concat(F.lit("turn "), (turn % 2).cast("string")))).when(turn % 3 == 1, few(F.lit(""), F.lit("small sample"))).otherwise(few()).alias("warnings"),
    )
    limits = c.where("conv_id % 2 = 0").select("conv_id", few(F.lit("one league")).alias("limits")).distinct()
    found = E.selected_evidence(records, "conv_id", limits)
    return found.select("conv_id", *[F.array_join(x, " ").alias(x) for x in E.CATEGORIES], F.array_join("warnings", "|").alias("warnings"), "status")
