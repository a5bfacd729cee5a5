import json
import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from touchline.operators import model_choice as M
from touchline.operators import ordering as O
from touchline.operators import selection as X
from touchline.operators import traces as T
from touchline.sources import json_lines as L

# Models and splits -------------------------------------------------------------------------------------------------------


def test_choice_by_log_loss_brier_and_name(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.6)], "y int, p double")
    pick = lambda **c: next(r.model for r in M.scored_candidates(rows, "y", {k: F.expr(v) for k, v in c.items()}).collect() if r.chosen)
    assert pick(z="p", a="0.5", b="1 - p") == "z" and pick(z="p", a="p") == "a"
    got = {r.model: r for r in M.scored_candidates(rows, "y", {"z": F.col("p")}).collect()}["z"]
    assert got.log_loss == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.6)) / 3) and got.brier == pytest.approx((0.01 + 0.04 + 0.16) / 3) and got.n == 3


def test_importances():
    assert M.importances(["a", "b", "c"], [1.0, 3.0, 0.0]) == [("b", 0.75), ("a", 0.25), ("c", 0.0)] and M.importances(["b", "a"], [0.0, 0.0]) == [("a", 0.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        M.importances(["a"], [])


def test_frozen_splits_must_fit(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "m int, v string")
    split = lambda *r: spark.createDataFrame(list(r), "m int, part string")
    assert {(r.v, r.part) for r in M.with_frozen_split(rows, split((1, "train"), (2, "test")), "m").collect()} == {("x", "train"), ("y", "train"), ("z", "test")}
    for bad, message in ((split((1, "train")), "1 missing"), (split((1, "train"), (2, "test"), (3, "test")), "1 without rows"), (split((1, "train"), (2, "test"), (2, "train")), "1 groups repeated")):
        with pytest.raises(ValueError, match=message):
            M.with_frozen_split(rows, bad, "m")


def test_calibration_parts(spark):
    rows = spark.range(34).withColumnRenamed("id", "m")
    parts = M.calibration_parts(X.folds(rows, "m", 5), "m").collect()
    assert len(parts) == 170
    for fold in range(1, 6):
        mine = {r.m: r.part for r in parts if r.outer_fold == fold}
        held = sum(p == "held_out" for p in mine.values())
        assert held in (6, 7) and sum(p == "calibration" for p in mine.values()) == 2 and len(mine) == 34
    small = M.calibration_parts(X.folds(rows.limit(4), "m", 2), "m").collect()
    assert {(r.outer_fold, r.part) for r in small} == {(f, p) for f in (1, 2) for p in ("held_out", "calibration", "fit")}


def test_comparison_of_two_models(spark):
    rows = spark.createDataFrame([(1, "p", 0.1, 0.2), (2, "p", -0.3, 0.1), (3, "q", 0.5, 0.5), (4, "q", None, 1.0)], "id int, t string, a double, b double")
    got = {r.t: r for r in M.impact_comparison(rows, "t", "a", "b").collect()}
    assert got["p"].n == 2 and got["p"].mean_gap == pytest.approx(0.25) and got["p"].same_sign == 0.5 and got["q"].n == 1
    assert [(r.id, r["rank"]) for r in M.largest_disagreements(rows, "id", "a", "b", 2).orderBy("rank").collect()] == [(2, 1), (1, 2)]


# JSON lines --------------------------------------------------------------------------------------------------------------

SCHEMA = "k string, n long, tags array<string>"


def test_lines_are_read_strictly(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"k": "a", "n": 1, "tags": ["x"]}\n\n{"k": "b"}\r\n')
    assert sorted(tuple(r) for r in L.read_lines(spark, str(good), SCHEMA).collect()) == [("a", 1, ["x"]), ("b", None, None)]
    for i, line in enumerate(["not json", "[1]", '{"k": "a", "n": "text"}', '{"k": ', "5"]):
        bad = tmp_path / f"bad{i}.jsonl"
        bad.write_text('{"k": "a"}\n\n' + line + "\n")
        with pytest.raises(Exception, match=rf"bad{i}.jsonl line 3 isn't"):
            L.read_lines(spark, str(bad), SCHEMA).collect()


def test_lines_are_appended(spark, tmp_path):
    path = str(tmp_path / "trace")
    rows = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], SCHEMA)
    L.append_lines(rows, path)
    L.append_lines(rows.limit(1), path)
    assert L.read_lines(spark, path, SCHEMA).count() == 3


def test_labelled_examples(spark, tmp_path):
    def examples(*rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return L.labelled_examples(spark, str(path), "id string, label string", "id", "label", ["pass", "fail"])

    assert examples({"id": "a", "label": "pass"}, {"id": "b", "label": "fail"}).count() == 2
    for bad, message in (([{"id": "a", "label": "pass"}] * 2, "1 distinct id"), ([{"id": "a", "label": "maybe"}], "1 labels outside"), ([{"id": "a"}], "1 labels outside")):
        with pytest.raises(ValueError, match=message):
            examples(*bad)


def test_sidecars_and_pipelines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a long, b double")
    path = str(tmp_path / "x")
    meta = L.write_with_sidecar(rows, path, {"version": "v1"})
    read, again = L.read_with_sidecar(spark, path)
    assert meta == again == {"version": "v1", "columns": ["a", "b"], "rows": 2} and read.count() == 2
    rows.write.mode("append").parquet(f"{path}/table")
    with pytest.raises(ValueError, match="doesn't match"):
        L.read_with_sidecar(spark, path)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(rows)
    L.save_pipeline(model, str(tmp_path / "model"))
    L.save_pipeline(model, str(tmp_path / "model"))
    assert L.load_pipeline(str(tmp_path / "model")).transform(rows).orderBy("a").first().v.toArray().tolist() == [1.0, 2.0]


def test_paired_sources():
    assert L.paired(a=1, b=2) and not L.paired(a=None, b=None)
    with pytest.raises(ValueError, match="a need b"):
        L.paired(a=1, b=None)


# Runs and calls ----------------------------------------------------------------------------------------------------------


def test_calls_that_repeat(spark):
    calls = [(1, 1, "t", '{"a": 1, "b": [1, 2]}'), (2, 1, "t", '{"b":[1,2],"a":1}'), (3, 1, "t", '{"b":[2,1],"a":1}'), (4, 1, "u", '{"a": 1, "b": [1, 2]}'), (5, 2, "t", '{"a": 1, "b": [1, 2]}'), (6, 1, "t", '{"a": "1", "b": [1, 2]}'), (7, 1, "t", "no json"), (8, 1, "t", "no json"), (9, 1, "t", None), (10, 1, "t", None)]
    found = T.first_calls(spark.createDataFrame(calls, "at int, run int, tool string, args string"), "run", "tool", "args", "at").collect()
    assert {r["at"]: r.repeats for r in found} == {1: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 9: 1}


def test_arguments_are_hidden_and_cut(spark):
    rows = spark.createDataFrame([({"api_KEY": "s", "q": "x" * 100, "Authorization": "b", "short": "y", "none": None},)], "m map<string,string>")
    assert rows.select(T.shown_arguments(F.col("m"), 10).alias("m")).first().m == {"api_KEY": "[redacted]", "Authorization": "[redacted]", "q": "x" * 10 + "…", "short": "y", "none": None}


def test_run_overview(spark):
    runs = spark.createDataFrame([("ok", float(i), 1.0) for i in range(1, 20)] + [("bad", None, 2.0)], "status string, latency double, cost double")
    r = T.run_overview(runs, ["ok", "bad", "none"]).first()
    assert (r.runs, r.ok, r.bad, r.none, r.ok_rate, r.none_rate) == (20, 19, 1, 0, 0.95, 0.0) and (r.p50_latency, r.p95_latency, r.mean_latency, r.total_cost) == (10.0, 19.0, 10.0, 21.0)
    assert T.run_overview(runs.withColumn("cost", F.when(F.col("latency") != 3, F.col("cost"))), ["ok"]).first().total_cost is None
    empty = T.run_overview(runs.limit(0), ["ok"]).first()
    assert (empty.runs, empty.ok_rate, empty.p50_latency, empty.total_cost) == (0, None, None, None)


@pytest.mark.parametrize("n", [1, 2, 3, 20, 100])
def test_nearest_ranks(spark, n):
    rows = spark.range(1, n + 1).select((F.col("id") * 2).alias("v"))
    assert tuple(O.nearest_ranks(rows, "v", {"a": 0.5, "b": 0.95, "c": 1.0, "d": 0.01}).first()) == tuple(2 * max(1, math.ceil(round(p * n, 9))) for p in (0.5, 0.95, 1.0, 0.01))


def test_results_worth_keeping(spark):
    rows = [("http://a.com/x", "On Alpha", 1, 1), ("http://a.com/x/", "on alpha", 9, 5), ("http://www.a.com/y", "alpha", 2, 9), ("http://b.com", "alpha", 40, 9), ("http://c.com", "other", 1, 9), ("http://d.com", "ALPHA", None, 0), ("http://e.com", "alpha", 3, 3), ("http://f.com", "alpha", 3, 2)]
    table = spark.createDataFrame([("alpha", *r) for r in rows], "subject string, url string, title string, age_days int, quality int")
    assert [(r.url, r["rank"]) for r in T.selected_results(table, "subject", 30).orderBy("rank").collect()] == [("http://www.a.com/y", 1), ("http://e.com", 2), ("http://f.com", 3)]
    assert [r.url for r in T.selected_results(table, "subject", None, 2).orderBy("rank").collect()] == ["http://www.a.com/y", "http://b.com"]


def test_names_must_agree(spark):
    table = lambda *r: spark.createDataFrame(list(r), "id int, name string")
    assert {tuple(r) for r in T.names_by_id([table((1, "a"), (1, "a"), (None, "z")), table((2, "b"), (1, "a"))], "id", "name").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError, match="1 values of id"):
        T.names_by_id([table((1, "a")), table((1, "b"))], "id", "name")


def test_subsets_keep_rows_without_a_player(spark):
    rows = spark.createDataFrame([(1, 1, "DEF", 5), (1, 1, "DEF", None), (1, 2, "MID", 6), (2, 1, "DEF", 7)], "team_id int, match_id int, position_group string, player_id int")
    count = lambda **k: X.subset(rows, **k).count()
    assert (count(), count(teams=[1]), count(matches=[1]), count(group="DEF"), count(without_player=5), count(teams=[1], matches=[1], group="DEF", without_player=5), count(teams=[])) == (4, 3, 3, 3, 3, 1, 0)
