"""Temperature scaling: one positive number per group that divides the margins, fitted by log loss and kept only if it helps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = 0.2, 5.0
GRID, ROUNDS = 25, 5
"""Temperatures tried at once, and narrowings of the interval around the best one: 24 ** 5 parts of log(25)."""
CLIP, BOUND = 1e-7, 35.0
LEAST_LOG_LOSS, LEAST_BRIER, MOST_ECE = 0.001, 0.0002, 0.002


def probability(margin: Column, temperature: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), margin / temperature))))


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def fit_temperature(rows: DataFrame, group: str, margin: str, y: str, grid: int = GRID, rounds: int = ROUNDS) -> DataFrame:
    """(group, temperature): the minimum of the mean log loss between 0.2 and 5.

    Equal rows are counted once. One aggregate evaluates the whole grid of every group; the next grid lies between the neighbours of the
    best point. The loss falls and then rises along the logarithm of the temperature, so the minimum stays inside.
    """
    counted = rows.where(F.col(margin).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("g"), F.col(margin).alias("z"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n")).persist()
    try:
        bounds = counted.select("g").distinct().select("g", F.lit(math.log(LOWEST)).alias("lo"), F.lit(math.log(HIGHEST)).alias("hi"))
        for _ in range(rounds):
            at = [F.col("lo") + (F.col("hi") - F.col("lo")) * j / (grid - 1) for j in range(grid)]
            losses = counted.join(F.broadcast(bounds), "g").groupBy("g", "lo", "hi").agg(*[(F.sum(F.col("n") * log_loss(probability(F.col("z"), F.exp(t)), F.col("y"))) / F.sum("n")).alias(f"l{j}") for j, t in enumerate(at)])  # a row per group
            best = F.array_min(F.array(*[F.struct(F.round(f"l{j}", 12).alias("l"), F.lit(j).alias("j")) for j in range(grid)]))["j"]
            step = (F.col("hi") - F.col("lo")) / (grid - 1)
            place = losses.select("g", "lo", "hi", best.alias("j"), step.alias("step")).collect()  # a row per group
            narrowed = [(r.g, max(r.lo, r.lo + (r.j - 1) * r.step), min(r.hi, r.lo + (r.j + 1) * r.step), r.lo + r.j * r.step) for r in place]
            bounds = rows.sparkSession.createDataFrame([r[:3] for r in narrowed], bounds.schema)
            found = [(r[0], math.exp(r[3])) for r in narrowed]
        kind = counted.schema["g"].dataType.simpleString()
        return rows.sparkSession.createDataFrame(found, f"`{group}` {kind}, temperature double")
    finally:
        counted.unpersist()


def assessed(rows: DataFrame, group: str, margin: str, y: str, temperatures: DataFrame, strict: bool = True, tolerance: float = 1e-6, bins: int = 10) -> DataFrame:
    """Per group: temperature, loss, Brier score and calibration error before and after, whether scaling is kept, and the temperature to use.

    ``strict``: log loss falls by 0.001, Brier by 0.0002, and the calibration error rises by at most 0.002. Otherwise all three must
    improve, the last not worsen, by more than ``tolerance``.
    """
    joined = rows.where(F.col(margin).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(temperatures), group)  # a row per group
    both = F.array(F.struct(F.lit("raw").alias("kind"), probability(F.col(margin), F.lit(1.0)).alias("p")), F.struct(F.lit("scaled").alias("kind"), probability(F.col(margin), F.col("temperature")).alias("p")))
    each = joined.select(group, "temperature", F.col(y).cast("int").alias("y"), F.explode(both).alias("k")).select(group, "temperature", "y", "k.kind", "k.p")
    b = F.greatest(F.ceil(F.col("p") * bins), F.lit(1))
    binned = each.groupBy(group, "temperature", "kind", b.alias("b")).agg(F.count("*").alias("n"), F.sum(log_loss(F.col("p"), F.col("y"))).alias("l"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("q"), F.sum("p").alias("p"), F.sum("y").alias("y"))
    n = F.sum("n")
    scores = binned.groupBy(group, "temperature", "kind").agg((F.sum("l") / n).alias("log_loss"), (F.sum("q") / n).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"))
    wide = scores.groupBy(group, "temperature").agg(*[F.max(F.when(F.col("kind") == kind, F.col(m))).alias(f"{kind}_{m}") for kind in ("raw", "scaled") for m in ("log_loss", "brier", "ece")])
    gain = lambda m: F.col(f"raw_{m}") - F.col(f"scaled_{m}")
    if strict:
        kept = (gain("log_loss") >= LEAST_LOG_LOSS) & (gain("brier") >= LEAST_BRIER) & (gain("ece") >= -MOST_ECE)
    else:
        kept = (gain("log_loss") > tolerance) & (gain("brier") > tolerance) & (gain("ece") >= -tolerance)
    return wide.withColumns({"retained": kept, "used": F.when(kept, F.col("temperature")).otherwise(1.0)})
