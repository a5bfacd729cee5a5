"""Nested cross-fitting: labels of an outer split from models that saw neither the row's inner fold nor, for held-out rows, the outer fold.

``nested_labels`` trains a model per inner fold and keeps predictions under a manifest; ``nested_rates`` does the same for the rate of a
category in closed form, all outer folds in one job.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.selection import folds
from touchline.operators.values import Fit
from touchline.sources.scratch import stored

MANIFEST = "manifest string"
TRAIN, HELD_OUT = "train_inner_oof", "outer_heldout"


def groups_fingerprint(rows: DataFrame, group: str) -> dict[str, int | str]:
    """Number of distinct groups and a hash of them that doesn't depend on their order; nothing but three numbers leaves Spark."""
    one = rows.select(F.col(group).cast("string").alias("g")).distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64("g").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("x")).first()
    return {"groups": one.n, "hash": f"{int(one.s or 0):x}:{one.x or 0:x}"}


def _kept(rows_path: str, manifest: dict, spark) -> DataFrame | None:
    """Stored predictions whose manifest has the same fields and whose rows are complete."""
    try:
        written = spark.read.schema(MANIFEST).json(f"{rows_path}/manifest").collect()  # a line per run that finished
    except Exception as problem:  # no manifest yet
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise
    for line in written:
        found = json.loads(line.manifest)
        if all(found.get(k) == v for k, v in manifest.items()):
            table = spark.read.parquet(f"{rows_path}/{found['version']}")
            if table.count() == found["predictions"] == table.select("id").distinct().count():
                return table
    return None


def nested_labels(rows: DataFrame, train: DataFrame, held_out: DataFrame, id_col: str, group: str, fit: Fit, settings: dict, path: str, inner: int = 5, lowest: float | None = 0.0, highest: float | None = 1.0) -> DataFrame:
    """(id, group, prediction, outer_role, inner_fold) for the rows of two disjoint sets of groups.

    Rows of ``train`` get the prediction of a model fitted on the other inner folds of ``train``, rows of ``held_out`` that of one
    fitted on all of ``train``. The result is stored under ``path``; it is used again only if the fingerprints of both sets, the number of
    rows and ``settings`` (which name the model) are those of its manifest, and its rows are complete.
    """
    spark, rows = rows.sparkSession, stored(rows, "nested-rows")
    if train.select(group).join(held_out.select(group), group, "left_semi").limit(1).count():
        raise ValueError("outer training and held-out groups overlap")
    inside, outside = rows.join(train.select(group).distinct(), group, "left_semi"), rows.join(held_out.select(group).distinct(), group, "left_semi")
    known = rows.select(group).distinct()
    if train.select(group).union(held_out.select(group)).join(known, group, "left_anti").limit(1).count():
        raise ValueError("the split has groups outside of the rows")
    manifest = {"settings": settings, "inner": inner, "train": groups_fingerprint(inside, group), "held_out": groups_fingerprint(outside, group), "rows": [inside.count(), outside.count()]}
    manifest = json.loads(json.dumps(manifest))
    if (kept := _kept(path, manifest, spark)) is not None:
        return kept
    joined = stored(inside.join(folds(inside, group, inner), group), "inner-rows")
    role = lambda found, name, fold: found.select(F.col(id_col).alias("id"), F.col(group).alias("group"), "prediction", F.lit(name).alias("outer_role"), F.lit(fold).alias("inner_fold"))
    parts = [role(fit(joined.where(F.col("fold") != i).drop("fold"))(joined.where(F.col("fold") == i).drop("fold")), TRAIN, i) for i in range(1, inner + 1)]
    found = reduce(DataFrame.unionByName, [*parts, role(fit(inside)(outside), HELD_OUT, 0)])
    version = uuid.uuid4().hex
    found.write.parquet(f"{path}/{version}")
    table = spark.read.parquet(f"{path}/{version}")
    inside_bounds = F.lit(True) if lowest is None else F.col("prediction").between(lowest, highest)
    check = table.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(F.col("prediction").isNull() | F.isnan("prediction") | ~inside_bounds, 1)).alias("bad")).first()
    if check.n != sum(manifest["rows"]) or check.ids != check.n or check.bad:
        raise ValueError(f"expected one prediction within bounds for each of {sum(manifest['rows'])} rows, found {check.n}, {check.ids} ids, {check.bad} outside")
    line = json.dumps(manifest | {"version": version, "predictions": check.n})
    spark.createDataFrame([(line,)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return table


def nested_rates(rows: DataFrame, id_col: str, group: str, category: str, label: str, outer: int = 5, inner: int = 5, prior: float = 1.0) -> DataFrame:
    """(outer_fold, id, group, outer_role, inner_fold, prediction) for every outer fold and row: the category's rate of ``label``, drawn to the overall one.

    A rate is a sum over the outer fold's training groups less that over the row's own inner fold, so one aggregate over
    (outer fold, inner fold, category) serves all models.
    """
    groups = rows.select(group).distinct()
    place = folds(groups, group, outer)
    each = place.select(group, F.col("fold").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(outer))).alias("outer_fold"))
    # ranks over groups: the training groups of an outer fold are dealt in turn, in the order of their hash
    order = Window.partitionBy("outer_fold", "held").orderBy(F.md5(F.col(group).cast("string").cast("binary")), group)
    dealt = each.withColumn("held", F.col("own") == F.col("outer_fold")).withColumn("inner_fold", F.when(F.col("held"), 0).otherwise((F.row_number().over(order) - 1) % inner + 1).cast("int"))
    per = rows.groupBy(group, F.col(category).alias("c")).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count("*").alias("n"))
    cells = per.join(dealt, group).groupBy("outer_fold", "inner_fold", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    train = cells.where("inner_fold > 0")
    whole, overall = train.groupBy("outer_fold", "c").agg(F.sum("s").alias("ws"), F.sum("n").alias("wn")), train.groupBy("outer_fold").agg(F.sum("s").alias("os"), F.sum("n").alias("on"))
    own_all = train.groupBy("outer_fold", "inner_fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    own = train.select("outer_fold", "inner_fold", "c", F.col("s").alias("cs"), F.col("n").alias("cn"))
    # all of these have a row per fold and category
    marked = rows.select(F.col(id_col).alias("id"), F.col(group).alias("group"), F.col(category).alias("c")).join(dealt.withColumnRenamed(group, "group"), "group")
    joined = marked.join(overall, "outer_fold").join(whole, ["outer_fold", "c"], "left").join(own_all, ["outer_fold", "inner_fold"], "left").join(own, ["outer_fold", "inner_fold", "c"], "left")
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    base = F.try_divide(less("os", "fs"), less("on", "fn").cast("double"))
    rate = (less("ws", "cs") + prior * base) / (less("wn", "cn") + prior)
    return joined.select("outer_fold", "id", "group", F.when(F.col("held"), HELD_OUT).otherwise(TRAIN).alias("outer_role"), "inner_fold", rate.alias("prediction"))
