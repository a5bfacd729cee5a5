import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.dates import published_since
from touchline.operators import cluster_reports as R
from touchline.operators import evidence as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    data = []
    for i in range(60):
        label = i % 2
        v = rng.normal([4 * label - 2, 0.1, 3 - 6 * label, 0.5], 0.5)
        data.append((i, label, "DEF" if label else "MID", [float(x) for x in v], float(v[0]), float(v[2])))
    return spark.createDataFrame(data, "id long, label int, grp string, v array<double>, a double, b double").repartition(3)


def test_centres_and_margins(rows):
    table = {(r.label, r.feature): r for r in R.centre_table(rows, "label", "v", ["w", "x", "y", "z"], 2).collect()}
    data = [r.asDict() for r in rows.collect()]
    for label in (0, 1):
        x = np.array([d["v"] for d in data if d["label"] == label])
        for i, name in enumerate("wxyz"):
            r = table[label, name]
            assert r.size == 30 and r["mean"] == pytest.approx(x[:, i].mean()) and r["std"] == pytest.approx(x[:, i].std())
        assert [n for n in "wxyz" if table[label, n].distinguishing] == ["w", "y"] and table[label, "y"].place == 1
    centre = {label: np.array([d["v"] for d in data if d["label"] == label]).mean(axis=0) for label in (0, 1)}
    for r in R.margins(rows, "id", "v", "label").collect():
        v = np.array(data[[d["id"] for d in data].index(r.id)]["v"])
        own, other = (np.linalg.norm(v - centre[k]) for k in (r.label, 1 - r.label))
        assert (r.distance, r.second_distance, r.margin) == (pytest.approx(own), pytest.approx(other), pytest.approx((other - own) / other))


def test_names_need_every_direction():
    names, called = ["long", "progress", "safe"], ("direct", "patient")
    centres = {0: np.array([0.5, 0.2, 0.1]), 1: np.array([-0.5, -0.2, 0.4])}
    assert R.named_pair(centres, names, ["long", "progress"], ["safe"], called) == {0: "direct", 1: "patient"}
    assert R.named_pair({0: -centres[0], 1: -centres[1]}, names, ["long", "progress"], ["safe"], called) == {1: "direct", 0: "patient"}
    for i in range(3):
        bad = {k: c.copy() for k, c in centres.items()}
        bad[0][i], bad[1][i] = bad[1][i], bad[0][i]
        with pytest.raises(ValueError, match="bear out"):
            R.named_pair(bad, names, ["long", "progress"], ["safe"], called)
    with pytest.raises(ValueError, match="two complete"):
        R.named_pair({**centres, 2: centres[0]}, names, ["long"], ["safe"], called)


def test_sensitivity_to_a_feature(rows):
    two = rows.select("id", F.array(F.col("a"), F.lit(0.0), F.col("b") / 10).alias("v"))
    found = {r.left_out: r.ari for r in R.sensitivity(two, "id", "v", ["main", "none", "small"], 2, 2, 2, 5).collect()}
    assert found["none"] == pytest.approx(1) and found["small"] == pytest.approx(1) and found["main"] == pytest.approx(1)
    alone = rows.select("id", F.array(F.col("a"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double") / 100).alias("v"))
    assert {r.left_out: r.ari for r in R.sensitivity(alone, "id", "v", ["main", "noise"], 2, 2, 2, 5).collect()}["main"] < 0.3


@pytest.mark.parametrize("fit", [R.centroid_labels, R.logistic_labels])
def test_predicted_labels(rows, fit):
    found = R.predicted_labels(rows, "id", "grp", ["a", "b"], fit=fit)
    assert found.count() == 60 and {(r.grp, r["count"]) for r in found.groupBy("grp", "fold").count().collect()} == {("DEF", 6), ("MID", 6)}
    report = R.classification_report(found, "grp", "predicted").first()
    assert report.rows == 60 and report.accuracy == report.balanced_accuracy == report.macro_f1 == 1.0 and report.majority_baseline == 0.5


def test_few_labels_have_fewer_folds_or_none(rows):
    few = rows.where("grp = 'MID' or id in (1, 3, 5)")
    assert R.stratified_folds(few, "id", "grp")[1] == 3
    assert R.stratified_folds(rows.where("grp = 'MID' or id = 1"), "id", "grp")[1] == 0
    assert R.predicted_labels(rows.where("grp = 'MID'"), "id", "grp", ["a"]).count() == 0


def test_classification_report(spark):
    pairs = [("a", "a"), ("a", "b"), ("a", "a"), ("b", "b"), ("c", "a"), ("c", "d")]
    r = R.classification_report(spark.createDataFrame(pairs, "x string, y string"), "x", "y").first()
    f1 = {"a": 4 / 6, "b": 2 / 3, "c": 0.0, "d": 0.0}
    assert (r.rows, r.accuracy, r.balanced_accuracy, r.macro_f1, r.majority_baseline) == (6, 0.5, pytest.approx((2 / 3 + 1 + 0) / 3), pytest.approx(sum(f1.values()) / 4), 0.5)


DECISION = "half_distance double, median_resample double, median_top6 double, candidate_spearman double, candidate_top6 double, players int, concentrated boolean"


@pytest.mark.parametrize(
    ("numbers", "role", "fit"),
    [
        ((1.0, 0.35, 0.67, 0.7, 0.67, 3, False), R.GO, R.LIMITED),
        ((1.0, 0.35, 0.66, 0.7, 0.67, 3, False), R.GO, R.NO),
        ((1.0, 0.35, 0.67, None, 0.67, 3, False), R.GO, R.NO),
        ((1.1, 0.35, 0.9, 0.9, 0.9, 3, False), R.LIMITED, R.NO),
        ((0.5, 0.2, 0.9, 0.9, 0.9, 3, True), R.LIMITED, R.NO),
        ((0.5, 0.51, 0.9, 0.9, 0.9, 3, False), R.NO, R.NO),
        ((0.5, 0.2, 0.9, 0.9, 0.9, 2, False), R.NO, R.NO),
        ((None, None, None, None, None, 3, None), R.NO, R.NO),
    ],
)
def test_role_decisions(spark, numbers, role, fit):
    r = R.role_decisions(spark.createDataFrame([numbers], DECISION)).first()
    assert (r.role_decision, r.fit_decision) == (role, fit)


def test_overall_decisions(spark):
    rows = [(1, R.GO, R.NO), (1, R.GO, R.LIMITED), (2, R.GO, R.NO), (2, R.NO, R.NO), (3, R.NO, R.NO)]
    got = {r.t: (r.roles, r.role_overall, r.fit_overall) for r in R.overall_decisions(spark.createDataFrame(rows, "t int, role_decision string, fit_decision string"), ["t"]).collect()}
    assert got == {1: (2, R.GO, R.LIMITED), 2: (2, R.LIMITED, R.NO), 3: (1, R.NO, R.NO)}


# Freshness and evidence --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("question", "since"),
    [
        ("in the last 7 days", "2024-05-03"), ("Past 1 day", "2024-05-09"), ("last 0 days", None), ("last 3651 days", None), ("last 99999 days", None), ("the past month", "2024-04-10"), ("since 2023-2-5", "2023-02-05"), ("since 2023-02-30", None), ("since 1999-01-01", None),
        ("since March 3", "2024-03-03"), ("Since JUNE 1", "2023-06-01"), ("since june 1, 2024", "2024-06-01"), ("since february 30", None), ("since february 29 2023", None), ("news from 2022", "2022-01-01"), ("News about A B in 2021", "2021-01-01"), ("goals in 2021", None), ("last 0 days since 2024-01-01", "2024-01-01"), ("", None), (None, None),
    ],
)
def test_published_since(spark, question, since):
    row = spark.createDataFrame([(question, datetime.date(2024, 5, 10))], "q string, d date").select(published_since(F.col("q"), F.col("d")).alias("s")).first()
    assert row.s == (since and datetime.date.fromisoformat(since))


def test_selected_evidence(spark):
    records = [(1, 2, "w", "web", "success", ["late", "b\x07"]), (1, 1, "a1", "analytics", "success", ["b", ""]), (1, 3, "a2", "analytics", "failed", ["x"]), (1, 4, "a3", "analytics", "success", None), (1, 5, "o", "other", "success", ["y"]), (2, 1, "m", "methodology", "failed", ["z"])]
    table = spark.createDataFrame(records, "q int, at int, evidence_id string, category string, status string, warnings array<string>")
    limits = spark.createDataFrame([(1, [" first ", "late"])], "q int, limits array<string>")
    got = {r.q: r for r in E.selected_evidence(table, "q", limits).collect()}
    assert (got[1].analytics, got[1].methodology, got[1].web, got[1].warnings, got[1].status) == (["a1", "a3"], [], ["w"], ["first", "late", "b"], "sufficient")
    assert (got[2].methodology, got[2].warnings, got[2].status) == ([], [], "insufficient")
    assert {r.q: r.warnings for r in E.selected_evidence(table, "q").collect()} == {1: ["b", "late"], 2: []}
