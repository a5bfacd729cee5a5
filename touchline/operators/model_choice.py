"""Choice between models and splits of matches: validation scores, importances, frozen splits, calibration parts, comparison of two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.calibration import log_loss


def scored_candidates(rows: DataFrame, y: str, candidates: dict[str, Column]) -> DataFrame:
    """(model, n, log_loss, brier, chosen): all candidates scored in one pass; the least log loss is chosen, then the least Brier score, then the first name."""
    each = rows.select(F.col(y).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.cast("double").alias("p")) for n, p in candidates.items()])).alias("c"))
    p = F.col("c.p")
    scores = each.groupBy(F.col("c.model").alias("model")).agg(F.count("*").alias("n"), F.avg(log_loss(p, F.col("y"))).alias("log_loss"), F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier"))
    first = F.row_number().over(Window.orderBy(F.round("log_loss", 9), F.round("brier", 9), "model"))  # a row per candidate
    return scores.withColumn("chosen", first == 1)


def importances(names: list[str], values: list[float]) -> list[tuple[str, float]]:
    """Importances as shares of their sum, largest first; zeros where nothing was gained."""
    if len(names) != len(values):
        raise ValueError("a name for each importance")
    total = sum(values)
    shares = [(n, v / total if total else 0.0) for n, v in zip(names, values, strict=True)]
    return sorted(shares, key=lambda x: (-x[1], x[0]))


def with_frozen_split(rows: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """``rows`` with the ``part`` that a stored split gives their group; raises if groups repeat in the split, lack from it, or have no rows."""
    groups = rows.select(group).distinct()
    repeated = split.groupBy(group).agg(F.countDistinct("part").alias("n"), F.count("*").alias("rows")).where("rows > 1").count()
    missing, unused = groups.join(split, group, "left_anti").count(), split.join(groups, group, "left_anti").count()
    if repeated or missing or unused:
        raise ValueError(f"the split doesn't fit: {repeated} groups repeated, {missing} missing, {unused} without rows")
    return rows.join(split.select(group, "part"), group)


def calibration_parts(folds: DataFrame, group: str, share: float = 0.1) -> DataFrame:
    """(outer_fold, group, part): for each outer fold its own groups are ``held_out``; of the others a share, one at least, is for ``calibration``, the rest for ``fit``."""
    each = folds.crossJoin(F.broadcast(folds.select(F.col("fold").alias("outer_fold")).distinct())).withColumn("held", F.col("fold") == F.col("outer_fold"))  # the folds
    order = F.md5(F.concat_ws(":", F.col("outer_fold").cast("string"), F.col(group).cast("string")).cast("binary"))
    w = Window.partitionBy("outer_fold", "held")
    size = F.greatest(F.floor(F.count("*").over(w) * share), F.lit(1))
    part = F.when(F.col("held"), "held_out").when(F.row_number().over(w.orderBy(order, group)) <= size, "calibration").otherwise("fit")
    return each.select("outer_fold", group, part.alias("part"))


def impact_comparison(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, mean_a, mean_b, mean_gap, pearson, same_sign) of two models' values."""
    x, y = F.col(a), F.col(b)
    kept = rows.where(x.isNotNull() & y.isNotNull())
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.avg(F.abs(x - y)).alias("mean_gap"), F.corr(x, y).alias("pearson"), F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("same_sign"))


def largest_disagreements(rows: DataFrame, key: str, a: str, b: str, k: int = 20) -> DataFrame:
    """The ``k`` rows on which two models differ most, with their rank."""
    gap = F.round(F.abs(F.col(a) - F.col(b)), 9)
    top = rows.where(gap.isNotNull()).withColumn("gap", gap).orderBy(F.desc("gap"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), key)))  # k rows
