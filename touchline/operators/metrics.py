"""Quality of probabilities, values, labels and clusters, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordering import running_sums
from touchline.sources.scratch import stored

CLIP = 1e-7


def probability_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Log loss, Brier score, accuracy at 0.5, and the exact AUC. Rows are first counted by (p, y), so the ranks run over distinct scores."""
    counts = stored(rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("p"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n")), "scores")
    clipped = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    loss = -F.when(F.col("y") == 1, F.log(clipped)).otherwise(F.log(F.lit(1.0) - clipped))
    n, positive, negative = F.sum("n"), F.sum(F.col("n") * F.col("y")), F.sum(F.col("n") * (1 - F.col("y")))
    base = counts.agg(
        n.alias("n"), positive.alias("positives"), F.round(F.sum(F.col("n") * loss) / n, 6).alias("log_loss"),
        F.round(F.sum(F.col("n") * (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))) / n, 6).alias("brier"),
        F.round(F.sum(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), F.col("n")).otherwise(0)) / n, 6).alias("accuracy"), positive.alias("_p"), negative.alias("_q"),
    )
    scores = counts.groupBy("p").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    auc = running_sums(scores, ["p"], {"upto": "neg"}).agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("_u"))
    joined = base.crossJoin(auc)  # one row each
    return joined.select("n", "positives", "log_loss", "brier", "accuracy", F.round(F.try_divide(F.col("_u"), (F.col("_p") * F.col("_q")).cast("double")), 6).alias("auc"))


def reliability_curve(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Right-closed equal bins with mean prediction and observed rate."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("predicted"), F.round(F.avg(F.col(y).cast("double")), 6).alias("observed"))


def calibration_error(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("a"), F.avg(F.col(y).cast("double")).alias("o"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("o"))) / F.sum("n"), 6).alias("ece"))


def regression_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, RMSE, R2 as 1 - SSE / SST, and Pearson's r."""
    e, n = F.col(y) - F.col(p), F.count("*")
    sst = F.var_pop(y) * n
    return rows.agg(
        n.alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.lit(1.0) - F.try_divide(F.sum(e * e), sst), 6).alias("r2"), F.round(F.corr(y, p), 6).alias("pearson"),
    )


def class_scores(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 = 2TP / (2TP + FP + FN) of every label that occurs on either side."""
    counts = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("a") != F.col("p"), F.col("n")).otherwise(0).alias("fn"))
    other = counts.where("a <> p").select(F.col("p").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    s = sides.unionAll(other).groupBy("label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return s.select("label", "tp", "fp", "fn", F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    two = lambda c: c * (c - 1) / 2
    counts = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    index = counts.agg(F.sum(two(F.col("n"))).alias("idx"), two(F.sum("n")).alias("whole"))
    left = counts.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("l"))
    right = counts.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("r"))
    one = index.crossJoin(left).crossJoin(right)  # one row each
    expected = F.try_divide(F.col("l") * F.col("r"), F.col("whole"))
    return one.select(F.round(F.coalesce(F.try_divide(F.col("idx") - expected, (F.col("l") + F.col("r")) / 2 - expected), F.lit(1.0)), 6).alias("adjusted_rand"))


def nearest_rank(value: str, p: float) -> Column:
    """sorted[ceil(p * n) - 1]: the smallest value whose cumulative share reaches p."""
    return F.percentile_disc(p) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) within group (order by {value})")


def complete_sum(value: str) -> Column:
    """The sum, null if any value is missing."""
    return F.when(F.count("*") == F.count(value), F.sum(value))
