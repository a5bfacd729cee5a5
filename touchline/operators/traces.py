"""Runs and their calls: overview with rates and costs, tool frequency, calls that repeat, arguments fit to be shown, results worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import nearest_ranks

SECRET_NAMES = r"(?i)(key|token|secret|password|authorization)"


def canonical_json(text: Column) -> Column:
    """JSON with keys in order and no spaces, numbers and nesting kept; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def first_calls(calls: DataFrame, run: str, tool: str, arguments: str, order: str) -> DataFrame:
    """Calls without those that repeat an earlier one of their run with the same tool and equal arguments, whatever their spelling."""
    same = F.coalesce(canonical_json(F.col(arguments)), F.col(arguments))
    w = Window.partitionBy(run, tool, "_same").orderBy(order)
    kept = calls.withColumn("_same", same).withColumn("_r", F.row_number().over(w)).withColumn("repeats", F.count("*").over(Window.partitionBy(run, tool, "_same")) - 1)
    return kept.where("_r = 1").withColumn("arguments_canonical", F.col("_same")).drop("_same", "_r")


def shown_arguments(arguments: Column, most: int = 80) -> Column:
    """A map of arguments for a trace: values of secret names are hidden, long ones cut."""
    cut = lambda v: F.when(F.length(v) > most, F.concat(F.substring(v, F.lit(1), F.lit(most)), F.lit("…"))).otherwise(v)
    return F.transform_values(arguments, lambda k, v: F.when(F.rlike(k, F.lit(SECRET_NAMES)), F.lit("[redacted]")).otherwise(cut(v)))


def run_overview(runs: DataFrame, statuses: list[str]) -> DataFrame:
    """One row over runs (status, latency, cost): how many, per status count and share, latency mean, median and 95 % by nearest rank, total cost.

    The total is null if a single cost is missing; missing latencies are left out.
    """
    n = F.count("*")
    each = [x for s in statuses for x in (F.count(F.when(F.col("status") == s, 1)).alias(s), F.try_divide(F.count(F.when(F.col("status") == s, 1)).cast("double"), n.cast("double")).alias(f"{s}_rate"))]
    one = runs.agg(n.alias("runs"), *each, F.avg("latency").alias("mean_latency"), F.when(F.count("cost") == n, F.sum("cost")).alias("total_cost"), F.count("cost").alias("priced"))
    return one.crossJoin(nearest_ranks(runs, "latency", {"p50_latency": 0.5, "p95_latency": 0.95}))  # one row each


def tool_frequency(calls: DataFrame, run: str, tool: str) -> DataFrame:
    """(tool, calls, runs, share): how often each tool is called, in how many runs, and its share of all calls."""
    per = calls.groupBy(tool).agg(F.count("*").alias("calls"), F.countDistinct(run).alias("runs"))
    return per.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy()))  # a row per tool


def selected_results(results: DataFrame, subject: str, most_days: int | None, limit: int = 3) -> DataFrame:
    """Per subject the best results: their title speaks of it, they are recent enough, each page and host once.

    ``results``: url, title, age_days (null: unknown, kept), quality; ranked by quality, age, url.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#]+)", 1))
    fits = F.contains(F.lower("title"), F.lower(subject)) & (F.coalesce(F.col("age_days") <= most_days, F.lit(True)) if most_days is not None else F.lit(True))
    rows = results.where(fits).withColumns({"plain_url": F.regexp_replace("url", "/+$", ""), "host": host})
    order = [F.desc("quality"), F.col("age_days").asc_nulls_last(), F.col("url")]
    for key in ("plain_url", "host"):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(subject, key).orderBy(*order))).where("_r = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(subject).orderBy(*order))).where(F.col("rank") <= limit).drop("_r")


def names_by_id(sources: list[DataFrame], key: str, name: str) -> DataFrame:
    """(key, name) of all sources; raises if an id has two names."""
    every = sources[0].select(key, name)
    for s in sources[1:]:
        every = every.unionByName(s.select(key, name))
    held = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias(name), F.max(name).alias("_other"))
    if conflicts := held.where(F.col(name) != F.col("_other")).count():
        raise ValueError(f"{conflicts} values of {key} have more than one {name}")
    return held.drop("_other")
