"""What clusters are made of: sizes, centres, distinguishing features, names that the centres must bear out, margins, sensitivity, predictability."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import clustering as C
from touchline.sources.scratch import stored

EPSILON = 1e-12


def centre_table(rows: DataFrame, label: str, vector: str, names: list[str], top: int = 4) -> DataFrame:
    """(label, size, feature, mean, std, place, distinguishing): features of each cluster, the largest absolute means first."""
    each = rows.select(label, F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col(vector).alias("x"))).alias("p")).select(label, "p.feature", "p.x")
    per = each.groupBy(label, "feature").agg(F.count("*").alias("size"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    order = Window.partitionBy(label).orderBy(F.round(F.abs("mean"), 9).desc(), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")))
    return per.withColumn("place", F.row_number().over(order)).withColumn("distinguishing", F.col("place") <= top)


def named_pair(centres: dict[int, np.ndarray], names: list[str], more: list[str], less: list[str], called: tuple[str, str]) -> dict[int, str]:
    """Names of two clusters: the first for the one with more of ``more`` and less of ``less``. Raises if a single feature points the other way."""
    if len(centres) != 2 or any(len(c) != len(names) for c in centres.values()):
        raise ValueError("two complete centres are needed")
    at = {n: i for i, n in enumerate(names)}
    score = lambda c: sum(c[at[n]] for n in more) - sum(c[at[n]] for n in less)
    first, second = sorted(centres, key=lambda k: (-score(centres[k]), k))
    wrong = [n for n in more if centres[first][at[n]] <= centres[second][at[n]]] + [n for n in less if centres[first][at[n]] >= centres[second][at[n]]]
    if wrong:
        raise ValueError(f"centres don't bear out {called[0]} and {called[1]}: {', '.join(wrong)}")
    return {first: called[0], second: called[1]}


def margins(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, distance, second_distance, margin): to the own centre and the nearest other one; the margin is their gap by the larger one."""
    dims = F.size(F.col(vector))
    size = rows.select(dims.alias("d")).limit(1).collect()
    centres = rows.groupBy(F.col(label).alias("l")).agg(F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(size[0].d if size else 0)]).cast("array<double>").alias("c"))
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("l", "c"))).alias("all"))  # a centre per label
    far = rows.crossJoin(F.broadcast(listed)).withColumn("d", F.transform("all", lambda x: F.struct(x["l"].alias("l"), F.sqrt(C.squared(F.col(vector), x["c"])).alias("d"))))  # one row
    own = F.filter("d", lambda x: x["l"] == F.col(label))[0]["d"]
    second = F.array_min(F.transform(F.filter("d", lambda x: x["l"] != F.col(label)), lambda x: x["d"]))
    return far.select(key, label, own.alias("distance"), second.alias("second_distance"), ((second - own) / F.greatest(second, F.lit(EPSILON))).alias("margin"))


def sensitivity(rows: DataFrame, key: str, vector: str, names: list[str], k: int, seeds: int, restarts: int, rounds: int) -> DataFrame:
    """(left_out, ari): clusterings without one feature at a time against the one with all, fitted together.

    A feature that is left out is 0 in every row of its runs; runs 0 to ``seeds`` - 1 have all features, the next ones lack the first, and so on.
    """
    masked = lambda s: F.col(vector) if s == 0 else F.transform(vector, lambda x, i: F.when(i == s - 1, 0.0).otherwise(x))
    runs = lambda s: F.sequence(F.lit(s * seeds), F.lit(s * seeds + seeds - 1))
    members = stored(reduce(DataFrame.unionByName, [rows.select(key, masked(s).alias("v"), runs(s).alias("runs")) for s in range(len(names) + 1)]), "sensitivity-rows")
    fits = C.Fits(members, key, k, restarts, rounds)
    best = fits.best().withColumn("s", F.floor(F.col("run") / seeds).cast("int")).groupBy("s").agg(F.min(F.struct("inertia", "fit")).alias("m")).select("s", "m.fit")
    found = stored(fits.near().join(F.broadcast(best), "fit").select(F.col("s").alias("run"), key, "label"), "sensitivity-labels")  # a row per feature
    reference = found.where("run = 0").select(key, F.col("label").alias("reference"))
    ari = C.rand_indices(C.contingency(found.where("run > 0"), reference, key))
    return ari.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("run")).alias("left_out"), "ari")


# Predictability ----------------------------------------------------------------------------------------------------------


def stratified_folds(rows: DataFrame, key: str, label: str, most: int = 5) -> tuple[DataFrame, int]:
    """(key, label, fold) and the number of folds: rows of each label are dealt in turn by the hash of their key; no more folds than the rarest label has rows."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("labels")).first()
    folds = min(most, sizes.least or 0) if sizes.labels > 1 else 0
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.select(key, label, ((F.row_number().over(order) - 1) % max(folds, 1) + 1).cast("int").alias("fold")), folds if folds > 1 else 0


def predicted_labels(rows: DataFrame, key: str, label: str, features: list[str], most: int = 5, fit: Callable | None = None) -> DataFrame:
    """(key, label, fold, predicted): the label of each row from a model of the other folds; no row if there are too few of a label."""
    dealt, folds = stratified_folds(rows, key, label, most)
    joined = rows.select(key, *features).join(dealt, key)
    fit = fit or logistic_labels
    parts = [fit(joined.where(F.col("fold") != f), features, label)(joined.where(F.col("fold") == f)).select(key, label, "fold", "predicted") for f in range(1, folds + 1)]
    return reduce(DataFrame.unionByName, parts) if parts else joined.select(key, label, "fold", F.col(label).alias("predicted")).limit(0)


def logistic_labels(train: DataFrame, features: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """Multinomial logistic regression on standardised features."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True), LogisticRegression(featuresCol="_z", labelCol="_y", maxIter=100, regParam=1e-3)]
    fitted = Pipeline(stages=stages).fit(index.transform(train))
    names = F.array(*[F.lit(n) for n in index.labels])
    return lambda rows: fitted.transform(rows).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))


def centroid_labels(train: DataFrame, features: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """The label of the nearest mean, after standardising by the training rows; ties go to the first label."""
    moments = train.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    centres = train.groupBy(F.col(label).alias("l")).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("l", *[f"c_{f}" for f in features]))).alias("all")).crossJoin(moments)  # a centre per label, one row

    def far(x: Column) -> Column:
        parts = [F.pow(F.try_divide(F.col(f) - x[f"c_{f}"], F.col(f"s_{f}")), F.lit(2.0)) for f in features]
        return F.round(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]), 9)

    return lambda rows: rows.crossJoin(F.broadcast(listed)).withColumn("predicted", F.array_min(F.transform("all", lambda x: F.struct(far(x).alias("d"), x["l"].alias("l"))))["l"])  # one row


def classification_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rows, accuracy, balanced accuracy (mean recall of the labels that occur), macro F1 over all labels of either side, share of the largest label."""
    counts = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0))
    by_a = counts.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("actual"), right.alias("hit"))
    by_p = counts.groupBy(F.col("p").alias("l")).agg(F.sum("n").alias("predicted"))
    each = by_a.join(by_p, "l", "full").select(F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), (F.col("actual") + F.col("predicted")).cast("double")), F.lit(0.0))
    return each.agg(
        F.sum("actual").alias("rows"), F.try_divide(F.sum("hit"), F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), F.try_divide(F.max("actual"), F.sum("actual")).alias("majority_baseline")
    )


# Decisions ---------------------------------------------------------------------------------------------------------------

# The limits that decide on a role and on its candidates.
HALF, RESAMPLE, RESAMPLE_LIMITED, TOP6, SPEARMAN, LEAST_PLAYERS = 1.0, 0.35, 0.5, 0.67, 0.7, 3
GO, LIMITED, NO = "GO", "GO WITH LIMITATIONS", "NO-GO"


def role_decisions(roles: DataFrame) -> DataFrame:
    """``roles`` with role_decision and fit_decision; a missing number doesn't meet its limit.

    Columns: half_distance, median_resample, median_top6, candidate_spearman, candidate_top6, players, concentrated.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    enough, spread = holds(F.col("players") >= LEAST_PLAYERS), ~F.coalesce("concentrated", F.lit(False))
    stable = holds((F.col("half_distance") <= HALF) & (F.col("median_resample") <= RESAMPLE))
    ranks = holds(F.col("median_top6") >= TOP6) & holds((F.col("candidate_spearman") >= SPEARMAN) & (F.col("candidate_top6") >= TOP6))
    role = F.when(stable & enough & spread, GO).when(holds(F.col("median_resample") <= RESAMPLE_LIMITED) & enough, LIMITED).otherwise(NO)
    return roles.withColumns({"role_decision": role, "fit_decision": F.when(stable & ranks & enough & spread, LIMITED).otherwise(NO)})


def overall_decisions(decided: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, roles, role_overall, fit_overall) over the roles of each key."""
    begins = lambda c: F.max(F.startswith(F.col(c), F.lit("GO")))
    return decided.groupBy(*keys).agg(
        F.count("*").alias("roles"), F.when(F.min(F.col("role_decision") == GO), GO).when(begins("role_decision"), LIMITED).otherwise(NO).alias("role_overall"), F.when(begins("fit_decision"), LIMITED).otherwise(NO).alias("fit_overall")
    )
