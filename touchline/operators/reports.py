"""Reports on groups, labels and outcomes, each a fold over aggregates of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import running_sums


def _total(column: str) -> Column:
    """The sum over all rows; only for aggregates, with a row per bin, label or distinct score."""
    return F.sum(column).over(Window.partitionBy())


def long_form(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, feature, value): a row for each column of each row."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    return rows.select(group, each).select(group, "x.*")


def group_location(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Count, mean and median of each column by group, and the column's eta squared (between by total sum of squares), from sums alone."""
    per = long_form(rows, group, columns).groupBy("feature", group).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.median("value").alias("median"))
    w = Window.partitionBy("feature")
    base = F.sum("s").over(w) * F.sum("s").over(w) / F.sum("n").over(w)
    eta = F.try_divide(F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n"))).over(w) - base, F.sum("q").over(w) - base)
    return per.select("feature", group, "n", F.round(F.try_divide("s", "n"), 4).alias("mean"), F.round("median", 4).alias("median"), F.round(eta, 4).alias("eta_squared"))


def availability(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """How many values of each column there are in each group."""
    per = long_form(rows, group, columns).groupBy("feature", group).agg(F.count("*").alias("rows"), F.count("value").alias("available"))
    return per.withColumn("missing_share", F.round(1 - F.col("available") / F.col("rows"), 6))


def metric_eligibility(rows: DataFrame, key: str, group: str, required: dict[str, tuple[str, int, str]], peers: int) -> DataFrame:
    """(key, group, metric, value, sample, peers, reason): the first reason that holds, in this order: no value, too small a sample, too few eligible peers.

    ``required``: metric -> (column of its sample size, the least size, its unit).
    """
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(s).cast("long").alias("sample"), F.lit(n).alias("needed"), F.lit(k).alias("kind")) for m, (s, n, k) in required.items()]
    long = rows.select(key, group, F.explode(F.array(*each)).alias("x")).select(key, group, "x.*")
    fine = F.col("value").isNotNull() & (F.col("sample") >= F.col("needed"))
    counted = long.withColumn("peers", F.count(F.when(fine, 1)).over(Window.partitionBy("metric", group)))
    reason = (
        F.when(F.col("value").isNull(), "metric_unavailable")
        .when(F.col("sample") < F.col("needed"), F.concat_ws("_", F.lit("requires"), F.col("needed").cast("string"), "kind"))
        .when(F.col("peers") < peers, f"requires_{peers}_eligible_position_peers")
        .otherwise("eligible")
    )
    return counted.withColumn("reason", reason)


def possession_geometry(actions: DataFrame, possession: list[str], order: list[str]) -> DataFrame:
    """The possession's key, match_number, x_progress, previous_success (false at the start) and next_start_distance (null at the end)."""
    w = Window.partitionBy(*possession).orderBy(*order)
    first = F.first("start_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dx, dy = F.lead("start_x").over(w) - F.col("end_x"), F.lead("start_y").over(w) - F.col("end_y")
    before = F.coalesce(F.lag(F.col("completed") == 1).over(w), F.lit(False))
    return actions.select(*possession, "match_number", F.round(F.col("start_x") - first, 6).alias("x_progress"), before.alias("previous_success"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("next_start_distance"))


def left_closed_bins(rows: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Calibration over bins [a, b); the last one holds 1 as well."""
    place = F.least(F.floor(F.col(p) * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def average_precision(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the precision-recall curve as a sum over distinct scores, ties taken together."""
    per = rows.groupBy(F.round(p, 9).alias("p")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    steps = running_sums(per, [F.desc("p")], {"tp": "pos", "seen": "n"})
    found = steps.agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("area"), F.sum("pos").alias("total"))
    return found.select(F.round(F.try_divide("area", F.col("total").cast("double")), 6).alias("average_precision"))


def nmi(rows: DataFrame, u: str, v: str) -> DataFrame:
    """Mutual information over the mean of both entropies, from the contingency table."""
    t = rows.groupBy(u, v).agg(F.count("*").cast("double").alias("n"))
    t = t.select(u, v, "n", _total("n").alias("total"), F.sum("n").over(Window.partitionBy(u)).alias("a"), F.sum("n").over(Window.partitionBy(v)).alias("b"))
    share = F.col("n") / F.col("total")
    # each row gives its part of a margin's entropy
    parts = t.agg(
        F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"),
        F.sum(-share * F.log(F.col("a") / F.col("total"))).alias("hu"),
        F.sum(-share * F.log(F.col("b") / F.col("total"))).alias("hv"),
    )
    return parts.select(F.round(F.try_divide(F.col("mi"), (F.col("hu") + F.col("hv")) / 2), 6).alias("nmi"))


def centroids(rows: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    return rows.groupBy(label).agg(F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dims)]).alias("centre"), F.count("*").alias("members"))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def calinski_harabasz(rows: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """Between by within dispersion, each over its degrees of freedom."""
    centres = centroids(rows, label, vector, dims)
    within = rows.join(centres, label).agg(F.sum(_squared(F.col(vector), F.col("centre"))).alias("w"), F.count("*").alias("n"))
    mean = rows.agg(F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dims)]).alias("mean"))
    between = centres.crossJoin(mean).agg(F.sum(F.col("members") * _squared(F.col("centre"), F.col("mean"))).alias("b"), F.count("*").alias("k"))  # a row per label, and one row
    score = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return within.crossJoin(between).select(F.round(score, 3).alias("score"))  # one row each


def rates(name: str) -> list[Column]:
    """Numerator, denominator and rate of a boolean column over the rows where it isn't null."""
    top, below = F.count(F.when(F.col(name), 1)), F.count(name)
    return [top.alias(f"{name}_numerator"), below.alias(f"{name}_denominator"), F.round(F.try_divide(top, below), 6).alias(f"{name}_rate")]


def distance_shares(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean squared difference of all pairs of a group in each dimension, and its share of the sum: twice the sample variance, so no pair is formed."""
    each = rows.select(group, F.posexplode(vector).alias("dim", "x"))
    squared = each.groupBy(group, "dim").agg((F.var_samp("x") * 2).alias("mean_squared"))
    return squared.withColumn("share", F.try_divide("mean_squared", F.sum("mean_squared").over(Window.partitionBy(group))))


def distinguishing(rows: DataFrame, label: str, vector: str, most: int = 4) -> DataFrame:
    """The dimensions in which a label's mean lies furthest from the mean of all, in standard deviations; ties to the earlier dimension."""
    each = rows.select(label, F.posexplode(vector).alias("dim", "x"))
    parts = each.groupBy(label, "dim").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))  # a row per label and dimension
    whole = Window.partitionBy("dim")
    n, mean = F.sum("n").over(whole), F.sum("s").over(whole) / F.sum("n").over(whole)
    spread = F.sqrt(F.sum("q").over(whole) / n - mean * mean)
    z = parts.select(label, "dim", F.round(F.try_divide(F.col("s") / F.col("n") - mean, spread), 6).alias("z"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.abs("z")), "dim"))
    return z.withColumn("rank", rank).where(F.col("rank") <= most)


def vector_summary(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Root mean square distance, cosine similarity and rank correlation (average ranks of ties) of two arrays of each row."""
    each = rows.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")))).select(key, F.round("col.x", 9).alias("x"), F.round("col.y", 9).alias("y"))
    own = Window.partitionBy(key)
    rank = lambda c: F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2
    ranked = each.withColumns({"rx": rank("x"), "ry": rank("y")})
    total = lambda c, d: F.sum(F.col(c) * F.col(d))
    apart = F.sqrt(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))))
    cosine = F.try_divide(total("x", "y"), F.sqrt(total("x", "x")) * F.sqrt(total("y", "y")))
    n, left, right = F.count("*"), F.sum("rx"), F.sum("ry")
    spearman = F.try_divide(n * total("rx", "ry") - left * right, F.sqrt(n * total("rx", "rx") - left * left) * F.sqrt(n * total("ry", "ry") - right * right))
    return ranked.groupBy(key).agg(F.round(apart, 6).alias("rms"), F.round(cosine, 6).alias("cosine"), F.round(spearman, 6).alias("spearman"))


def support(rows: DataFrame, observed: str, thresholds: list[int], enough: int = 20) -> DataFrame:
    """For each threshold: how many rows have at least so many observations, and whether these are enough for a conclusion."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    kept = rows.select(observed, levels.alias("threshold")).where(F.col(observed) >= F.col("threshold"))
    return kept.groupBy("threshold").agg(F.count("*").alias("eligible"), F.round(F.avg(observed), 6).alias("mean_observed"), (F.count("*") >= enough).alias("meaningful"))
