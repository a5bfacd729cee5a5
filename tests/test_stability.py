import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.operators import stability as N


def players(seed, n, groups=("DEF", "MID")):
    rng = random.Random(seed)
    return [(i, groups[i % len(groups)], [round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "player_id long, position_group string, v array<double>").repartition(4)


def brute(rows, k):
    out = {}
    for i, g, v in rows:
        near = sorted((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) / len(v)), 9), j) for j, h, w in rows if h == g and j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_neighbours_do_not_depend_on_blocks(spark, block):
    rows = [*players(1, 60), *[(100 + i, "MID", [0.5, 0.5, 0.5]) for i in range(8)], (200, "GK", [0.0, 0.0, 0.0])]
    got = {}
    for r in N.neighbours(table(spark, rows), "player_id", ["position_group"], 11, block=block).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
    want = brute(rows, 11)
    assert want.pop(200) == [] and got == want


def test_rankings_are_compared_like_lists(spark):
    rng = random.Random(7)
    full = {i: rng.sample(range(100, 130), 11) for i in range(5)} | {5: [1, 2, 3, 4, 6, 7, 8], 6: [1, 2]}
    other = {(run, i): rng.sample(range(100, 118), 11) for run in range(3) for i in range(5)} | {(0, 5): [8, 7, 6, 4, 3, 2, 1], (1, 6): [2, 1], (2, 9): [1, 2, 3]}
    rows = lambda d: [(*(k if isinstance(k, tuple) else (k,)), j, r) for k, ids in d.items() for r, j in enumerate(ids, 1)]
    a, b = spark.createDataFrame(rows(full), "left_id long, right_id long, rank int"), spark.createDataFrame(rows(other), "run int, left_id long, right_id long, rank int")
    got = {(r.run, r.left_id): r for r in N.compared(a, b, ["run"]).collect()}
    assert set(got) == {k for k in other if k[1] in full}
    for (run, i), r in got.items():
        x, y = full[i], other[run, i]
        assert r.candidates == min(len(x), len(y))
        for k in N.TOP:
            shared = len(set(x[:k]) & set(y[:k]))
            assert r[f"top_{k}_overlap"] == (shared / k if r.candidates > k else None)
            assert r[f"top_{k}_jaccard"] == (pytest.approx(shared / (2 * k - shared)) if r.candidates > k else None)
        common = [j for j in x if j in y]
        if len(common) < 3:
            assert r.rank_spearman is None
        else:
            u, v = pd.Series([x.index(j) for j in common]).rank(), pd.Series([y.index(j) for j in common]).rank()
            assert r.rank_spearman == pytest.approx(u.corr(v))
    assert got[0, 5].rank_spearman == -1.0 and got[0, 5].top_6_overlap == pytest.approx(5 / 6) and got[0, 5].top_10_overlap is None


def test_summaries(spark):
    rng = np.random.default_rng(0)
    x = rng.random(21)
    rows = [(i, "DEF" if i % 3 else "MID", *[float(v) if m == 2 else None for m in range(len(N.MEASURES))]) for i, v in enumerate(x)]
    schema = "left_id long, position_group string, " + ", ".join(f"{m} double" for m in N.MEASURES)
    got = {(r.position_group, r.measure): r for r in N.summarised(spark.createDataFrame(rows, schema), "position_group").collect()}
    assert set(got) == {(g, N.MEASURES[2]) for g in ("ALL", "DEF", "MID")}
    r = got["ALL", N.MEASURES[2]]
    assert r.n == 21 and r["mean"] == pytest.approx(x.mean()) and r.median == pytest.approx(np.median(x)) and r.p10 == pytest.approx(np.quantile(x, 0.1)) and r.p25 == pytest.approx(np.quantile(x, 0.25))


METHODS = "feature_set string, feature_count int, method string, split_mean double, split_median double, split_spearman double, resample_mean double"


def choose(spark, *rows):
    return N.chosen_method(spark.createDataFrame(list(rows), METHODS)).first()


def test_the_simplest_of_the_best_is_chosen(spark):
    good = (0.5, 0.3, 0.7)
    row = choose(spark, ("wide", 8, "rms", 0.52, *good), ("small", 4, "cosine", 0.5, *good), ("small", 4, "manhattan", 0.505, *good), ("tiny", 2, "rms", 0.4, *good))
    assert (row.feature_set, row.method) == ("small", "manhattan") and row.best_score == pytest.approx(0.61) and row.score == pytest.approx(0.6025)
    assert choose(spark, ("b", 4, "rms", 0.5, *good), ("a", 4, "rms", 0.5, *good)).feature_set == "a"
    assert choose(spark, ("b", 4, "rms", 0.51, *good), ("a", 4, "rms", 0.5, *good)).feature_set == "b"
    assert choose(spark, ("x", 1, "rms", None, *good), ("y", 9, "other", 0.1, *good)).feature_set == "y"
    assert N.chosen_method(spark.createDataFrame([("x", 1, "rms", None, *good)], METHODS)).count() == 0


@pytest.mark.parametrize(("numbers", "ok"), [((0.35, 1 / 3, 0.25, 0.6), True), ((0.34, 0.5, 0.3, 0.7), False), ((0.5, 0.3, 0.3, 0.7), False), ((0.5, 0.5, 0.2, 0.7), False), ((0.5, 0.5, 0.3, 0.59), False), ((0.5, None, 0.3, 0.7), False)])
def test_floors(spark, numbers, ok):
    assert choose(spark, ("a", 1, "rms", *numbers)).defensible is ok


def test_support(spark):
    p = spark.createDataFrame([(i, i) for i in range(1, 25)], "player_id long, matches long")
    m = spark.createDataFrame([("half", 3, 0.5), ("half", 20, 1.0), ("resample", 24, None)], "kind string, left_id long, top_6_overlap double")
    got = {(r.threshold, r.kind): (r.players, r.measurable, r.mean_overlap, r.meaningful) for r in N.by_support(p, m, "player_id", "matches", [2, 10, 30]).collect()}
    assert got == {(2, "half"): (23, 2, 0.75, True), (10, "half"): (15, 1, 1.0, False), (30, "half"): (0, 0, None, False), (2, "resample"): (23, 0, None, True), (10, "resample"): (15, 0, None, False), (30, "resample"): (0, 0, None, False)}


def test_small_groups_look_at_adjacent_ones(spark):
    sizes = {("a", "DEF"): 3, ("a", "MID"): 6, ("a", "FWD"): 2, ("a", "GK"): 2, ("b", "DEF"): 1}
    rows, i = [], 0
    for (cohort, group), n in sizes.items():
        for _ in range(n):
            rows.append((i, cohort, group, [float(i)]))
            i += 1
    group = {r[0]: (r[1], r[2]) for r in rows}
    got: dict[int, list] = {}
    for r in N.neighbours_with_fallback(spark.createDataFrame(rows, "player_id long, cohort string, grp string, v array<double>"), "player_id", "cohort", "grp", k=20).collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.fell_back))
    for p, (cohort, g) in group.items():
        others = {q for q, at in group.items() if at == (cohort, g) and q != p}
        short = len(others) < 5 and g != "GK"
        near = others | ({q for q, at in group.items() if at[0] == cohort and at[1] in N.ADJACENT[g]} if short else set())
        assert {q for q, _ in got.get(p, [])} == near and all(f == short for _, f in got.get(p, []))


def test_fall_back_ranks_large_groups_in_cells_and_null_distances_last(spark):
    rows = [(i, "a", "DEF" if i < 30 else "MID", None if i in (3, 31) else [float(i * i % 17)]) for i in range(33)]
    found = N.neighbours_with_fallback(spark.createDataFrame(rows, "player_id long, cohort string, grp string, v array<double>"), "player_id", "cohort", "grp", k=50)
    vectors = {r[0]: r[3] for r in rows}
    want = {}
    for p, _, g, v in rows:
        others = [(q, abs(v[0] - w[0]) if v and w else None) for q, _, h, w in rows if q != p and (g == "MID" or h == "DEF")]
        want[p] = [q for q, d in sorted(others, key=lambda x: (x[1] is None, x[1] or 0.0, x[0]))]
    got: dict[int, list] = {}
    for r in found.orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
        assert (r.distance is None) == (not vectors[r.left_id] or not vectors[r.right_id])
    assert got == want
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()


def test_cells_are_spread_over_tasks(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("pool"), F.array((F.col("id") * 7 % 101).cast("double")).alias("v"))
    found = N.cells.in_cells(rows, "id", ["pool"], ["v"], lambda a, b: {"n": pa.array([a.num_rows * b.num_rows])}, "n long")
    assert found.rdd.getNumPartitions() >= N.cells.CELLS and found.agg(F.sum("n")).first()[0] == 2 * 1500 * 1500


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("metric", ["rms", "manhattan", "cosine"])
def test_lists_hold_what_the_pairs_hold(spark, metric, block):
    """Ties, a null and a zero vector; small blocks make many lists of a row."""
    draw = random.Random(5)
    rows = [(i, "a" if i % 3 else "b", None if i == 7 else [0.0, 0.0] if i == 8 else [float(draw.randint(0, 3)), draw.random() if i % 2 else 1.0]) for i in range(60)] + [(99, "c", [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "id long, pool string, v array<double>")
    wanted: dict = {}
    for r in sorted(N.cells.nearest(frame, "id", ["pool"], "v", 11, metric, block).collect(), key=lambda r: r.rank):
        wanted.setdefault((r.pool, r.left_id), []).append(r.right_id)
    assert {(r.pool, r.left_id): r.near for r in N.cells.nearest_lists(frame, "id", ["pool"], "v", 11, metric, block).collect()} == wanted


def test_lists_are_compared_like_pairs(spark):
    rows = {"full": {1: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], 2: [1, 3, 4], 3: [1], 4: [2, 1, 5, 6, 7, 8, 9]}, "r": {1: [3, 2, 4, 6, 5, 20, 21, 9, 11, 30, 31], 2: [4, 3, 1], 3: [2], 5: [1], 4: [1, 2, 9, 8, 30, 31, 32]}}
    pairs = {n: spark.createDataFrame([(0, left, right, i + 1) for left, near in found.items() for i, right in enumerate(near)], "run int, left_id long, right_id long, rank int") for n, found in rows.items()}
    lists = {n: spark.createDataFrame([(0, left, near) for left, near in found.items()], "run int, left_id long, near array<long>") for n, found in rows.items()}
    wanted = N.compared(pairs["full"].drop("run"), pairs["r"], ["run"])
    found = N.compared_lists(lists["full"].drop("run"), lists["r"], ["run"])
    assert sorted(map(repr, (r.asDict() for r in found.select(wanted.columns).collect()))) == sorted(map(repr, (r.asDict() for r in wanted.collect())))
