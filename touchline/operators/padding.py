"""Possessions as padded sequences: statistics of training rows alone, ordered states, batches with masks.

``Encoder.fit`` learns medians, means, scales, modes and vocabularies from training rows; ``encode`` turns any rows into three
arrays; ``sequences`` gathers a possession's rows in order; ``padded`` fills up the sequences of a batch to its longest one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import group_medians, ordinals

UNKNOWN = "Unknown"
LEAST_SCALE = 1e-8
MOST_WORDS = 100_000
"""Distinct values of all categories together that may become a vocabulary."""


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def exact_medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """The median of each column's finite values, by running counts over its distinct values; None where there is none."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), _finite(c).alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    found = group_medians(each, "name", "value").collect()  # a row per column
    return {r.name: r.median for r in found}


class Encoder:
    """Learned from training rows by ``fit``."""

    def __init__(self, numbers: list[str], flags: list[str], categories: list[str]):
        self.numbers, self.flags, self.categories = numbers, flags, categories

    def fit(self, train: DataFrame) -> Encoder:
        self.medians = exact_medians(train, self.numbers)
        if missing := [c for c in self.numbers if self.medians.get(c) is None]:
            raise ValueError(f"no value of {', '.join(missing)} in the training rows")
        filled = {c: F.coalesce(_finite(c), F.lit(self.medians[c])) for c in self.numbers}
        moments = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in filled.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()], *[F.avg(_finite(c)).alias(f"f_{c}") for c in self.flags]).first()
        self.means = {c: moments[f"m_{c}"] for c in self.numbers}
        self.scales = {c: moments[f"s_{c}"] if moments[f"s_{c}"] >= LEAST_SCALE else 1.0 for c in self.numbers}
        self.modes = {c: float((moments[f"f_{c}"] or 0) > 0.5) for c in self.flags}
        self.vocabularies: dict[str, dict[str, int]] = {c: {UNKNOWN: 0} for c in self.categories}
        if not self.categories:
            return self
        each = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in self.categories])).alias("x")).select("x.*")
        words = each.where(F.col("value").isNotNull() & (F.col("value") != UNKNOWN)).distinct().orderBy("name", "value").limit(MOST_WORDS + 1).collect()
        if len(words) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} distinct categories")
        for name, value in words:
            self.vocabularies[name][value] = len(self.vocabularies[name])
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        """``rows`` with continuous, binary and categorical; a category that training didn't see is 0."""
        continuous = [(F.coalesce(_finite(c), F.lit(self.medians[c])) - F.lit(self.means[c])) / F.lit(self.scales[c]) for c in self.numbers]
        binary = [F.coalesce(_finite(c), F.lit(self.modes[c])) for c in self.flags]
        index = lambda c: F.create_map(*[F.lit(x) for item in self.vocabularies[c].items() for x in item])
        categorical = [F.coalesce(F.try_element_at(index(c), F.col(c).cast("string")), F.lit(0)) for c in self.categories]
        typed = lambda columns, kind: F.array(*columns).cast(f"array<{kind}>")
        return rows.withColumns({"continuous": typed(continuous, "double"), "binary": typed(binary, "double"), "categorical": typed(categorical, "int")})


def sequences(encoded: DataFrame, keys: list[str], order: str, id_col: str, target: str) -> DataFrame:
    """(keys, length, steps): a possession's rows in order. Raises if a place or an id occurs twice, or a target is missing, negative or not finite."""
    t = F.col(target).cast("double")
    bad = ~F.coalesce((t >= 0) & ~F.isnan(t) & (t < F.lit(math.inf)), F.lit(False))
    step = F.struct(F.col(order).alias("at"), F.col(id_col).alias("id"), "continuous", "binary", "categorical", t.alias("target"))
    held = encoded.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("steps"), F.countDistinct(order).alias("places"), F.countDistinct(id_col).alias("ids"), F.max(bad).alias("bad"))
    ok = held.withColumn("length", F.size("steps"))
    fault = F.when(F.col("places") != F.col("length"), "two states share a place").when(F.col("ids") != F.col("length"), "ids must be unique and present").when(F.col("bad"), "targets must be finite and not negative")
    length = F.when(fault.isNull(), F.col("length")).otherwise(F.raise_error(fault).cast("int"))
    return ok.select(*keys, length.alias("length"), "steps")


def padded(found: DataFrame, keys: list[str], batch_size: int) -> DataFrame:
    """(keys, batch, length, width, mask, steps): sequences in the order of their keys, ``batch_size`` to a batch, filled with zeros to the longest of the batch."""
    batched = ordinals(found, keys, "place").withColumn("batch", F.floor(F.col("place") / batch_size)).withColumn("width", F.max("length").over(Window.partitionBy("batch")))
    first = F.get("steps", F.lit(0))
    zeros = lambda name, zero: F.array_repeat(F.lit(zero), F.size(first[name]))
    blank = F.struct(F.lit(None).cast(found.schema["steps"].dataType.elementType["at"].dataType).alias("at"), F.lit(None).cast(found.schema["steps"].dataType.elementType["id"].dataType).alias("id"), zeros("continuous", 0.0).alias("continuous"), zeros("binary", 0.0).alias("binary"), zeros("categorical", 0).alias("categorical"), F.lit(0.0).alias("target"))
    rest = F.col("width") - F.col("length")
    mask = F.concat(F.array_repeat(F.lit(True), F.col("length")), F.array_repeat(F.lit(False), rest))
    return batched.select(*keys, "batch", "length", "width", mask.alias("mask"), F.concat("steps", F.array_repeat(blank, rest)).alias("steps"))
