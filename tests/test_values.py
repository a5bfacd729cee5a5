import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import calibration as T
from touchline.operators import crossfit as X
from touchline.operators import ordering as O
from touchline.operators import values as V
from touchline.operators.models import out_of_fold
from touchline.operators.selection import folds
from touchline.sources.scratch import in_parts

# Order -------------------------------------------------------------------------------------------------------------------


def test_ordinals_and_running_sums(spark):
    rng = np.random.default_rng(3)
    data = [(int(i), float(v)) for i, v in enumerate(rng.permutation(500))]
    rows = spark.createDataFrame(data, "id long, v double").repartition(7)
    found = {r.id: (r.place, r.total) for r in O.running_sums(O.ordinals(rows, [F.desc("v")], "place"), ["v"], {"total": "id"}).collect()}
    ordered = sorted(data, key=lambda r: r[1])
    total = 0
    for place, (i, _) in enumerate(ordered):
        total += i
        assert found[i] == (len(data) - 1 - place, total)
    assert O.ordinals(rows.limit(0), ["v"]).count() == 0 and [r.ordinal for r in O.ordinals(rows.limit(1), ["v"]).collect()] == [0]


def test_average_ranks_and_spearman(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"x": rng.integers(0, 12, 300).astype(float), "y": rng.normal(size=300).round(1)})
    frame.loc[::17, "x"] = np.nan
    rows = spark.createDataFrame([(None if math.isnan(a) else float(a), float(b)) for a, b in frame.values], "x double, y double")
    kept = frame.dropna()
    ranks = dict(zip(kept.x, kept.x.rank(), strict=True))
    assert {r.x: r["rank"] for r in O.average_ranks(rows, "x").collect()} == ranks
    assert O.spearman(rows, "x", "y").first()[0] == pytest.approx(kept.x.rank().corr(kept.y.rank()))
    assert O.spearman(rows.withColumn("x", F.lit(1.0)), "x", "y").first()[0] is None


# Values ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def states(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        x, kind, flag = float(rng.normal()), ["a", "b", None][int(rng.integers(0, 3))], bool(rng.integers(0, 2))
        happens = rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * x)))
        rows.append((i, i % 30, None if i % 41 == 0 else x, kind, None if i % 37 == 0 else flag, float(np.exp(0.4 * x) * rng.gamma(2, 0.5)) if happens else 0.0))
    return spark.createDataFrame(rows, "id long, match_id long, x double, kind string, flag boolean, value double").repartition(4).cache()


FEATURES = V.Features(["x"], ["flag"], ["kind"])


@pytest.mark.parametrize("fit", [V.regressor(FEATURES, "value"), V.regressor(FEATURES, "value", "squared", trees=3), V.hurdle(FEATURES, "value")], ids=["tweedie", "squared", "hurdle"])
def test_values_are_nonnegative_keep_the_mean_and_beat_it(states, fit):
    found = V.cross_fitted(states, folds(states, "match_id", 3), "match_id", fit)
    assert found.count() == found.select("id").distinct().count() == 600
    one = found.agg(F.min("prediction"), F.avg("prediction"), F.avg("value"), F.avg((F.col("prediction") - F.col("value")) ** 2), F.var_pop("value")).first()
    assert one[0] >= 0 and one[1] == pytest.approx(one[2], rel=0.08) and one[3] < one[4]


def test_fits_and_predictions_read_stored_rows(states):
    w = Window.partitionBy("match_id").orderBy("id")
    rows = states.withColumn("x", F.coalesce("x", F.lag("x").over(w)))
    found = V.cross_fitted(rows, folds(rows, "match_id", 3), "match_id", V.regressor(FEATURES, "value"))
    assert "Window" not in found._jdf.queryExecution().toString() and found.count() == 600


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_out_of_fold_reads_stored_rows(states, kind):
    w = Window.partitionBy("match_id").orderBy("id")
    rows = states.select("id", "match_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("kind", F.lit("none")).alias("kind"), (F.col("value") > 0).alias("y"), F.row_number().over(w).alias("n"))
    found = out_of_fold(rows, folds(rows, "match_id", 2), "match_id", ["id"], "y", ["x", "n"], ["kind"], kind)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert found.select("id").distinct().count() == found.where("prediction between 0 and 1").count() == 600


def test_boosting_reads_counted_examples(spark, monkeypatch):
    """Their number is bounded by bins, not rows; every training row counts, and missing numbers have a bin of their own."""
    from touchline.operators import models

    seen = []
    monkeypatch.setattr(models, "in_parts", lambda rows, name: seen.append(rows) or in_parts(rows, name))
    rows = spark.range(30000).select("id", (F.col("id") % 20).alias("match_id"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 10007 / 10007).alias("x"), F.lit("k").alias("kind"))
    rows = rows.withColumn("y", F.coalesce(F.col("x") > 0.5, F.lit(True)))
    found = out_of_fold(rows, folds(rows, "match_id", 2), "match_id", ["id"], "y", ["x"], ["kind"], "gbt")
    kept = {r.id: r for r in found.join(rows.select("id", "x"), "id").collect()}
    assert len(kept) == 30000 and all(r.prediction > 0.5 if r.x is None or r.x > 0.55 else r.prediction < 0.5 for r in kept.values() if r.x is None or abs(r.x - 0.5) > 0.05)
    assert len(seen) == 2 and max(e.count() for e in seen) <= 2 * models.BINS
    assert sum(e.agg(F.sum("_rows")).first()[0] for e in seen) == 30000


def test_parts_hold_so_many_rows(spark):
    rows = in_parts(spark.range(10000), "parts", 1000)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 1100 and rows.distinct().count() == 10000
    assert in_parts(spark.range(0), "parts").count() == 0


def test_hurdle_is_a_product_and_handles_one_class(spark, states):
    found = V.hurdle(FEATURES, "value")(states)(states)
    assert found.where("abs(probability*magnitude - prediction) > 1e-12 or probability < 0 or probability > 1 or magnitude < 0").count() == 0
    zeros = states.withColumn("value", F.lit(0.0))
    assert {r.prediction for r in V.hurdle(FEATURES, "value")(zeros)(zeros).collect()} == {0.0}
    ones = states.withColumn("value", F.lit(2.0))
    assert {round(r.prediction, 4) for r in V.hurdle(V.Features(), "value")(ones)(ones).collect()} == {2.0}


def test_unseen_and_missing_features(spark, states):
    new = spark.createDataFrame([(1, 1, None, "never seen", None, 0.0)], states.schema)
    row = V.regressor(FEATURES, "value")(states)(new).first()
    assert row.prediction > 0 and row.kind == "never seen" and row.x is None


def test_predictions_that_are_not_finite_raise(spark):
    for bad in ("double('nan')", "double('infinity')", "cast(null as double)"):
        with pytest.raises(Exception, match="finite"):
            spark.range(1).select(V.nonnegative(F.expr(bad)).alias("v")).collect()
    assert spark.range(1).select(V.nonnegative(F.lit(-0.2)).alias("v")).first().v == 0.0


def test_value_metrics_and_buckets(spark):
    data = [(0.0, -0.1), (0.0, 0.02), (0.05, 0.04), (0.1, 0.2), (0.2, 0.1), (0.9, 0.5), (None, 0.5)]
    y, p = np.array([a for a, _ in data[:-1]]), np.array([max(b, 0) for _, b in data[:-1]])
    rows = spark.createDataFrame(data, "y double, p double")
    m = V.value_metrics(rows, "y", "p").first()
    assert m.n == 6 and m.mae == pytest.approx(abs(y - p).mean()) and m.positive_rmse == pytest.approx(np.sqrt(((y - p)[y > 0] ** 2).mean()))
    assert m.spearman == pytest.approx(pd.Series(y).rank().corr(pd.Series(p).rank())) and m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert {r.bucket: r.n for r in V.value_buckets(rows, "y", "p").collect()} == {"zero": 2, "0_to_0.05": 1, "0.05_to_0.10": 1, "0.10_to_0.20": 1, "above_0.20": 1}


# Nested cross-fitting ----------------------------------------------------------------------------------------------------


def mean_model(log):
    def fit(train):
        log.append({r.match_id for r in train.select("match_id").distinct().collect()})
        mean = train.agg(F.avg("value")).first()[0]
        return lambda rows: rows.withColumn("prediction", F.lit(float(mean)))

    return fit


def test_nested_labels_never_see_their_own_match(spark, states, tmp_path):
    place = folds(states, "match_id", 3)
    train, held = place.where("fold <> 1"), place.where("fold = 1")
    path, seen = str(tmp_path / "nested"), []
    bounds = {"lowest": 0.0, "highest": 100.0}
    call = lambda settings=("mean",), rows=states, a=train, b=held: X.nested_labels(rows, a, b, "id", "match_id", mean_model(seen), {"model": list(settings)}, path, inner=4, **bounds)
    found = call()
    held_out = {r.match_id for r in held.collect()}
    inner = {r.inner_fold: set() for r in found.select("inner_fold").distinct().collect()}
    for r in found.select("inner_fold", "group", "outer_role").distinct().collect():
        inner[r.inner_fold].add(r.group)
        assert (r.outer_role == X.HELD_OUT) == (r.group in held_out) == (r.inner_fold == 0)
    assert len(seen) == 5 and found.count() == 600
    for i, trained in zip([1, 2, 3, 4, 0], seen, strict=True):
        assert not trained & inner[i] and not trained & held_out
    # a match whose values are planted moves every label but its own
    planted = states.withColumn("value", F.when(F.col("match_id") == min(inner[1]), 1.0e1).otherwise(0.0))
    moved = {(r.group, r.prediction) for r in call(("planted",), planted).select("group", "prediction").distinct().collect()}
    assert {p for g, p in moved if g == min(inner[1])} == {0.0} and all(p > 0 for g, p in moved if g not in inner[1])
    # the cache
    count = len(seen)
    assert {tuple(r) for r in call().collect()} == {tuple(r) for r in found.collect()} and len(seen) == count
    call(("other",))
    assert len(seen) == count + 5
    call(a=place.where("fold = 2"))
    assert len(seen) == count + 10
    call(rows=states.where("id <> 7"))
    assert len(seen) == count + 15
    with pytest.raises(ValueError, match="overlap"):
        call(a=place, b=held)
    with pytest.raises(ValueError, match="outside"):
        call(b=spark.createDataFrame([(999,)], "match_id long"))


def test_nested_labels_check_bounds_and_ids(spark, states, tmp_path):
    place = folds(states, "match_id", 3)
    split = (place.where("fold <> 1"), place.where("fold = 1"))
    with pytest.raises(ValueError, match="within bounds"):
        X.nested_labels(states.withColumn("value", F.lit(5.0)), *split, "id", "match_id", mean_model([]), {}, str(tmp_path / "a"), inner=2)
    with pytest.raises(ValueError, match="ids"):
        X.nested_labels(states.withColumn("id", F.lit(1)), *split, "id", "match_id", mean_model([]), {}, str(tmp_path / "b"), inner=2, highest=100.0)


def test_nested_rates(spark, states):
    rows = states.select("id", "match_id", F.coalesce("kind", F.lit("-")).alias("kind"), (F.col("value") > 0).alias("y"))
    found = X.nested_rates(rows, "id", "match_id", "kind", "y", outer=3, inner=2)
    given, data = found.collect(), {r.id: r for r in rows.collect()}
    assert len(given) == 3 * 600
    fold = {(r.outer_fold, r.group): r.inner_fold for r in given}
    for r in given[::97]:
        train = [d for d in data.values() if fold[r.outer_fold, d.match_id] not in (0, r.inner_fold)]
        mine = [d.y for d in train if d.kind == data[r.id].kind]
        assert r.prediction == pytest.approx((sum(mine) + sum(d.y for d in train) / len(train)) / (len(mine) + 1))


# Temperature -------------------------------------------------------------------------------------------------------------


def test_temperature_is_the_minimum(spark):
    rng = np.random.default_rng(2)
    data, best = [], {}
    for g, t in (("hot", 2.3), ("cold", 0.6), ("edge", 9.0)):
        z = rng.normal(0, 2, 400).round(2)
        y = (rng.random(400) < 1 / (1 + np.exp(-z / t))).astype(int)
        data += [(g, float(a), int(b)) for a, b in zip(z, y, strict=True)]
        grid = np.exp(np.linspace(math.log(0.2), math.log(5), 60001))
        p = 1 / (1 + np.exp(-z[:, None] / grid[None, ::20]))
        losses = -np.where(y[:, None] == 1, np.log(p), np.log(1 - p)).mean(axis=0)
        best[g] = grid[::20][losses.argmin()]
    rows = spark.createDataFrame(data, "g string, z double, y int")
    fitted = T.fit_temperature(rows, "g", "z", "y")
    for r in fitted.collect():
        assert r.temperature == pytest.approx(best[r.g], abs=2e-3)
    loss = rows.join(fitted, "g").groupBy("g").agg(*[F.avg(T.log_loss(T.probability(F.col("z"), F.col("temperature") * k), F.col("y"))).alias(n) for n, k in (("at", 1.0), ("below", 0.9999), ("above", 1.0001))])
    assert all(r.at <= min(r.below, r.above) + 1e-12 for r in loss.where("g <> 'edge'").collect())
    judged = {r.g: r for r in T.assessed(rows, "g", "z", "y", fitted).collect()}
    assert judged["hot"].retained and judged["hot"].used == judged["hot"].temperature and judged["hot"].scaled_log_loss < judged["hot"].raw_log_loss


def test_scaling_that_gains_nothing_is_dropped(spark):
    rows = spark.createDataFrame([("g", z, y) for z, y, n in ((1.0986122886681098, 1, 75), (1.0986122886681098, 0, 25), (-1.0986122886681098, 1, 25), (-1.0986122886681098, 0, 75)) for _ in range(n)], "g string, z double, y int")
    fitted = T.fit_temperature(rows, "g", "z", "y")
    assert fitted.first().temperature == pytest.approx(1.0, abs=1e-4)
    for strict in (True, False):
        row = T.assessed(rows, "g", "z", "y", fitted, strict).first()
        assert not row.retained and row.used == 1.0


def test_group_medians(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.integers(0, 5, 301), "v": rng.normal(size=301).round(1)})
    rows = spark.createDataFrame([*[(int(a), float(b)) for a, b in frame.values], (0, None), (9, None)], "g int, v double").repartition(5)
    assert {r.g: (r.n, r.median) for r in O.group_medians(rows, "g", "v").collect()} == {g: (len(x), pytest.approx(x.v.median())) for g, x in frame.groupby("g")}
    assert O.group_medians(rows.limit(0), "g", "v").count() == 0


def test_models_of_one_condition_share_their_examples(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "id % 7 as a", "if(id % 3 = 0, 'x', 'y') as c", "cast(id % 7 > 3 or id % 5 = 0 as double) as v")
    features, made, in_parts = V.Features(["a"], [], ["c"]), [], V.in_parts
    monkeypatch.setattr(V, "in_parts", lambda *a: made.append(1) or in_parts(*a))
    models = {"few": {"kind": "trees", "trees": 2, "depth": 2}, "net": {"kind": "network", "trees": 5}, "line": {"ridge": 1e-3}}
    together = V.classifiers(features, "v > 0", models)(rows)(rows)
    assert made == [1] and together.columns == [*rows.columns, *models]
    found = {r.id: r for r in together.collect()}
    for name, how in models.items():
        alone = V.classifier(features, "v > 0", **how)(rows)(rows)
        assert all(r.prediction == pytest.approx(found[r.id][name], abs=1e-9) for r in alone.collect())
    one_class = V.classifiers(features, "v > 9", models)(rows)(rows)
    assert one_class.select(*models).distinct().collect() == [(0.0, 0.0, 0.0)]
