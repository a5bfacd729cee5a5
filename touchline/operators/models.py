"""Models on MLlib: cross-fitted predictions, clustering, principal components. Numbers follow MLlib; tests check invariants."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.scratch import in_parts, stored


def feature_stages(numeric: list[str], categories: list[str], output: str = "features") -> list:
    """Scaled numbers and one-hot categories; unseen categories have a slot of their own."""
    stages = [VectorAssembler(inputCols=numeric, outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
    encoded = []
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"_{c}_index", outputCol=f"_{c}_hot")]
        encoded.append(f"_{c}_hot")
    return [*stages, VectorAssembler(inputCols=["_scaled", *encoded], outputCol=output)]


def out_of_fold(rows: DataFrame, folds: DataFrame, group: str, ids: list[str], label: str, numeric: list[str], categories: list[str], kind: str = "logistic") -> DataFrame:
    """A probability for every row from a model that saw none of its fold. As many models as folds; the rows are worked out once for all of them."""
    columns = dict.fromkeys([*ids, "fold", label, *numeric, *categories])
    joined = stored(rows.join(folds, group).select(*columns, F.col(label).cast("double").alias("_label")), "fold-rows")
    parts = []
    for fold in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        train, held_out = joined.where(F.col("fold") != fold), joined.where(F.col("fold") == fold)
        if kind == "logistic":
            prepared = Pipeline(stages=feature_stages(numeric, categories)).fit(train)
            examples = prepared.transform(train).select("features", "_label")
            model = LogisticRegression(labelCol="_label", maxIter=50, regParam=1e-3)
        else:
            binned, bins = in_bins(train, numeric)
            counted = stored(binned(train).groupBy(*bins, *categories, "_label").agg(F.count("*").cast("double").alias("_rows")), "counted-examples")
            prepared = Pipeline(stages=feature_stages(bins, categories)).fit(counted)
            examples, held_out = prepared.transform(counted).select("features", "_label", "_rows"), binned(held_out)
            model = GBTClassifier(labelCol="_label", weightCol="_rows", maxIter=5, maxDepth=3, maxBins=BINS, seed=42)
        scored = PipelineModel([prepared, model.fit(in_parts(examples, "examples"))]).transform(held_out)
        parts.append(scored.select(*ids, "fold", F.col(label), vector_to_array("probability")[1].alias("prediction")))
    return reduce(DataFrame.unionByName, parts)


BINS = 32


def in_bins(train: DataFrame, numeric: list[str]) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """What adds a bin for each number, cut at quantiles of the training rows, and the bins' names; null and NaN are in the last.

    Trees cut at bins only, so rows of equal bins are one example with a weight: their number is bounded whatever the number of rows.
    """
    found = train.approxQuantile(numeric, [i / (BINS - 1) for i in range(1, BINS - 1)], 1e-3)
    given, bins = [f"_{c}_given" for c in numeric], [f"_{c}_bin" for c in numeric]
    cuts = [[-math.inf, *sorted(set(x) - {-math.inf, math.inf} or {0.0}), math.inf] for x in found]
    bucketizer = Bucketizer(inputCols=given, outputCols=bins, splitsArray=cuts, handleInvalid="keep")
    missing = F.lit(math.nan)
    return lambda rows: bucketizer.transform(rows.withColumns({g: F.coalesce(F.col(c).cast("double"), missing) for g, c in zip(given, numeric, strict=True)})).drop(*given), bins


def kmeans(rows: DataFrame, key: str, vector: str, k: int = 2, restarts: int = 3) -> DataFrame:
    """The clustering of least cost over seeded restarts; labels are ordered by the first component of their centre."""
    data = rows.select(key, array_to_vector(vector).alias("features")).persist()
    try:
        models = [KMeans(k=k, seed=42 + s, maxIter=50).fit(data) for s in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        order = sorted(range(k), key=lambda i: tuple(best.clusterCenters()[i]))
        label = F.element_at(F.create_map(*[F.lit(x) for i, old in enumerate(order) for x in (old, i)]), F.col("prediction"))
        return best.transform(data).select(key, label.alias("cluster"))
    finally:
        data.unpersist()


def gaussian_mixture(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    data = rows.select(key, array_to_vector(vector).alias("features"))
    scored = GaussianMixture(k=k, seed=42, maxIter=30).fit(data).transform(data)
    return scored.select(key, F.col("prediction").alias("component"), F.array_max(vector_to_array("probability")).alias("certainty"))


def principal_components(rows: DataFrame, key: str, vector: str, k: int = 3) -> DataFrame:
    """Scores on the first components; a component's sign is such that its largest loading is positive."""
    data = rows.select(key, array_to_vector(vector).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(data)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[:, i][abs(loadings[:, i]).argmax()] >= 0 else -1.0 for i in range(k)]
    scores = vector_to_array("scores")
    return model.transform(data).select(key, *[(F.get(scores, F.lit(i)) * s).alias(f"pc{i + 1}") for i, s in enumerate(signs)])
