"""Models of non-negative values with many zeros: preprocessing, Tweedie and boosted regressors, the hurdle model, cross-fitting, quality.

A ``Fit`` takes training rows and returns a function that adds ``prediction`` to any rows of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordering import spearman
from touchline.sources.scratch import in_parts, stored

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
UNKNOWN = "Unknown"


class Features:
    """Columns of a model: numbers (median for missing, standardised), flags (mode for missing), categories (missing is ``Unknown``, unseen has a slot)."""

    def __init__(self, numbers: list[str] = (), flags: list[str] = (), categories: list[str] = ()):
        self.numbers, self.flags, self.categories = list(numbers), list(flags), list(categories)

    def ready(self, rows: DataFrame) -> DataFrame:
        """``rows`` with working copies of the columns, so that callers' columns stay as they are."""
        plain = {f"_n_{c}": F.col(c).cast("double") for c in self.numbers} | {f"_f_{c}": F.col(c).cast("double") for c in self.flags}
        return rows.withColumns(plain | {f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in self.categories} | {"_one": F.lit(0.0)})

    def stages(self) -> list:
        stages, parts = [], ["_one"]
        if self.numbers:
            inputs = [f"_n_{c}" for c in self.numbers]
            stages += [Imputer(inputCols=inputs, outputCols=[f"{c}_filled" for c in inputs], strategy="median", relativeError=1e-4), VectorAssembler(inputCols=[f"{c}_filled" for c in inputs], outputCol="_numbers")]
            stages += [StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
            parts.append("_scaled")
        if self.flags:
            inputs = [f"_f_{c}" for c in self.flags]
            stages += [Imputer(inputCols=inputs, outputCols=[f"{c}_filled" for c in inputs], strategy="mode")]
            parts += [f"{c}_filled" for c in inputs]
        for c in self.categories:
            stages += [StringIndexer(inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}")]
            parts.append(f"_h_{c}")
        return [*stages, VectorAssembler(inputCols=parts, outputCol="_features")]


def nonnegative(value: Column) -> Column:
    """Noise below zero is cut off; what isn't finite raises."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.greatest(value, F.lit(0.0))).otherwise(F.raise_error(F.lit("predictions must be finite")).cast("double"))


def _examples(prepared: PipelineModel, ready: DataFrame) -> DataFrame:
    """What a model reads in each of its rounds, worked out once."""
    return in_parts(prepared.transform(ready).select("_features", "_target"), "examples")


def _fitted(features: Features, model, ready: DataFrame) -> PipelineModel:
    prepared = Pipeline(stages=features.stages()).fit(ready)
    return PipelineModel([prepared, model.fit(_examples(prepared, ready))])


def _drop_working(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return rows.select(*columns, *more)


def regressor(features: Features, target: str, kind: str = "tweedie", power: float = 1.3, ridge: float = 0.0, trees: int = 20, depth: int = 3, step: float = 0.1) -> Fit:
    """``tweedie``: a generalised linear model with logarithmic link; ``squared`` and ``absolute``: boosted trees of that loss."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        columns = {"labelCol": "_target", "featuresCol": "_features", "predictionCol": "_predicted"}
        if kind == "tweedie":
            model = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, regParam=ridge, maxIter=50, **columns)
        else:
            model = GBTRegressor(lossType=kind, maxIter=trees, maxDepth=depth, stepSize=step, seed=42, **columns)
        fitted = _fitted(features, model, features.ready(train).withColumn("_target", F.col(target).cast("double")))
        return lambda rows: _drop_working(fitted.transform(features.ready(rows)), rows.columns, nonnegative(F.col("_predicted")).alias("prediction"))

    return fit


def classifier(features: Features, label: str, kind: str = "logistic", ridge: float = 0.0, trees: int = 20, depth: int = 3) -> Fit:
    """The probability that the condition ``label`` holds, by ``logistic`` regression, a ``network`` with layers of 64 and 32, or boosted ``trees``; the rate itself where training rows have one class only."""
    return classifiers(features, label, {"prediction": {"kind": kind, "ridge": ridge, "trees": trees, "depth": depth}})


def classifiers(features: Features, label: str, models: dict[str, dict]) -> Fit:
    """Several models of one condition, by the name of the column that each adds; ``models`` holds what ``classifier`` takes.

    Features are prepared and examples worked out once for all models, and rows to predict meet them in one pass.
    """

    def model(kind: str = "logistic", ridge: float = 0.0, trees: int = 20, depth: int = 3, width=None):
        columns = {"labelCol": "_target", "featuresCol": "_features"}
        if kind == "logistic":
            return LogisticRegression(regParam=ridge, maxIter=100, tol=1e-8, **columns)
        if kind == "network":
            return MultilayerPerceptronClassifier(layers=[width(), 64, 32, 2], maxIter=trees, seed=42, **columns)
        return GBTClassifier(maxIter=trees, maxDepth=depth, seed=42, **columns)

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rate = train.agg(F.avg(F.expr(label).cast("double"))).first()[0]
        if rate in (None, 0.0, 1.0):
            return lambda rows: rows.withColumns({name: F.lit(float(rate or 0)) for name in models})
        ready = features.ready(train).withColumn("_target", F.expr(label).cast("double"))
        prepared = Pipeline(stages=features.stages()).fit(ready)
        examples = _examples(prepared, ready)
        width = lambda: prepared.transform(ready.limit(1)).first()["_features"].size
        fitted = [model(**how, width=width).fit(examples) for how in models.values()]
        for i, each in enumerate(fitted):
            each.setProbabilityCol(f"_probability_{i}").setRawPredictionCol("").setPredictionCol("")
        chain = PipelineModel([prepared, *fitted])
        chances = [vector_to_array(f"_probability_{i}")[1].alias(name) for i, name in enumerate(models)]
        return lambda rows: _drop_working(chain.transform(features.ready(rows)), rows.columns, *chances)

    return fit


def hurdle(features: Features, target: str, positive: str = "logistic", magnitude: str = "tweedie", power: float = 2.0, ridge: float = 0.0) -> Fit:
    """P(value > 0) times the expected value given that it is positive, each by a model of its own; adds ``probability`` and ``magnitude``."""
    chance, size = classifier(features, f"`{target}` > 0", positive, ridge), regressor(features, target, magnitude, power, ridge)

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        happens = chance(train)
        positives = train.where(F.col(target) > 0)
        sized = size(positives) if positives.limit(1).count() else lambda rows: rows.withColumn("prediction", F.lit(0.0))

        def predict(rows: DataFrame) -> DataFrame:
            both = sized(happens(rows).withColumnRenamed("prediction", "probability")).withColumnRenamed("prediction", "magnitude")
            return both.withColumn("prediction", F.col("probability") * F.col("magnitude"))

        return predict

    return fit


def cross_fitted(rows: DataFrame, folds: DataFrame, group: str, fit: Fit) -> DataFrame:
    """Every row with its ``fold`` and a prediction of a model that saw none of the fold's groups; one model per fold.

    The rows are stored, so that neither the fits nor the prediction, in which all folds come together, work them out again.
    """
    joined = stored(rows.join(folds, group), "fold-rows")
    parts = []
    for fold in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        parts.append(fit(joined.where(F.col("fold") != fold))(joined.where(F.col("fold") == fold)))
    return reduce(DataFrame.unionByName, parts)


# Quality ---------------------------------------------------------------------------------------------------------------


def value_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """One row: errors over all rows and over those with a positive target, R2, Spearman's rank correlation (0 if undefined), range of predictions."""
    v = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.greatest(F.col(p).cast("double"), F.lit(0.0)).alias("p"))
    e, positive = F.col("y") - F.col("p"), F.col("y") > 0
    one = v.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("r2"),
        F.avg(F.when(positive, F.abs(e))).alias("positive_mae"), F.sqrt(F.avg(F.when(positive, e * e))).alias("positive_rmse"), F.min("p").alias("prediction_min"), F.max("p").alias("prediction_max"),
    )
    return one.crossJoin(spearman(v, "y", "p").select(F.coalesce("spearman", F.lit(0.0)).alias("spearman")))  # one row each


BUCKETS = [("zero", None, 0.0), ("0_to_0.05", 0.0, 0.05), ("0.05_to_0.10", 0.05, 0.1), ("0.10_to_0.20", 0.1, 0.2), ("above_0.20", 0.2, None)]
"""Fixed values: name, above, up to."""


def value_buckets(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Counts, errors and means by the size of the target."""
    v = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.greatest(F.col(p).cast("double"), F.lit(0.0)).alias("p"))
    bucket = None
    for name, _, upto in BUCKETS:
        fits = F.col("y") <= upto if upto is not None else F.lit(True)
        bucket = F.when(fits, name) if bucket is None else bucket.when(fits, name)
    e = F.col("y") - F.col("p")
    return v.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("y").alias("mean_actual"), F.avg("p").alias("mean_predicted"))
