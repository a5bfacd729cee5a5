"""Evidence of a question: what was found, by category, with its warnings once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import without_controls

CATEGORIES = ["analytics", "methodology", "web"]


def selected_evidence(records: DataFrame, key: str, limits: DataFrame | None = None) -> DataFrame:
    """(key, analytics, methodology, web, warnings, status): ids of successful records in their order, by category.

    ``records``: at, evidence_id, category, status, warnings (array). Warnings are those of ``limits`` (key, limits) and then of the selected
    records, by category and order, cleaned of control characters, trimmed, without empty ones, each once. ``status``: sufficient if a category
    has evidence.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    kept = records.where((F.col("status") == "success") & (place > 0)).withColumn("place", place)
    line = F.struct("place", "at", "evidence_id", "category", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    held = kept.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("r"))  # one question's records
    joined = records.select(key).distinct().join(held, key, "left")
    joined = joined.join(limits, key, "left") if limits is not None else joined.withColumn("limits", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    r = F.coalesce("r", F.array().cast(held.schema["r"].dataType))

    def of(category: str) -> Column:
        return F.transform(F.filter(r, lambda x: x["category"] == category), lambda x: x["evidence_id"]).alias(category)

    said = F.concat(F.coalesce("limits", none), F.flatten(F.transform(r, lambda x: x["warnings"])))
    clean = F.array_distinct(F.filter(F.transform(said, lambda x: F.trim(without_controls(x))), lambda x: x.isNotNull() & (x != "")))
    return joined.select(key, *[of(c) for c in CATEGORIES], clean.alias("warnings"), F.when(F.size(r) > 0, "sufficient").otherwise("insufficient").alias("status"))
