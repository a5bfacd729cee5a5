import numpy as np
import pytest

from touchline.operators import cells as C
from touchline.operators import clustering as K
from touchline.operators import similarity as V


def _frame(spark, x, pools=None, labels=None):
    rows = [(None if pools is None else pools[i], i * 3, None if v is None else [float(a) if a is not None else None for a in v], None if labels is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame([(p or "a", i, v, lab) for p, i, v, lab in rows], "pool string, id long, v array<double>, label int")


def _plain(d):
    return sorted(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select("pool", "left_id", "rank", "right_id", "distance").collect())


@pytest.mark.parametrize("metric", ["rms", "manhattan", "cosine"])
def test_nearest_in_cells_equals_all_pairs(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 1).tolist()  # many ties
    x[5], x[17] = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    x[40], x[90], x[91] = [1.0, None, 2.0], None, [None, 0.0, 0.0]
    rows = _frame(spark, x, ["ab"[i % 2] for i in range(300)])
    pairs = V.blocked_pairs(rows, "id", ["pool"]).select("pool", "left_id", "right_id", V.METRICS[metric]("a", "b").alias("distance"))
    whole = {}
    for r in pairs.collect():
        whole.setdefault((r.pool, r.left_id), []).append((float("inf") if r.distance is None else round(r.distance, 9), r.right_id, r.distance))
    wanted = sorted((p, i, n + 1, j, None if d is None else round(d, 9)) for (p, i), found in whole.items() for n, (_, j, d) in enumerate(sorted(found, key=lambda f: f[:2])[:7]))
    assert len(wanted) == 300 * 7
    assert sorted(map(repr, _plain(C.nearest(rows, "id", ["pool"], "v", 7, metric, block=40)))) == sorted(map(repr, wanted))


def test_nearest_passes_over_leaves_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    found = C.nearest(_frame(spark, x), "id", ["pool"], "v", 5).collect()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).mean(axis=2))
    np.fill_diagonal(d, np.inf)
    assert {(r.left_id // 3, r["rank"]): r.right_id // 3 for r in found} == {(i, n + 1): j for i, best in enumerate(np.argsort(d, axis=1)[:, :5].tolist()) for n, j in enumerate(best)}


def test_few_rows_and_no_rows(spark):
    rows = _frame(spark, [[0.0], [1.0], [5.0]], ["a", "a", "b"])
    assert [(r.left_id, r.right_id, r["rank"]) for r in C.nearest(rows, "id", ["pool"], "v", 5).orderBy("left_id").collect()] == [(0, 3, 1), (3, 0, 1)]
    assert C.nearest(rows.limit(0), "id", ["pool"], "v", 5).count() == 0
    assert [tuple(r) for r in C.distance_medians(rows, "id", "pool", "v").collect()] == [("a", 1, 1.0)]


@pytest.mark.parametrize("n", [61, 62])
def test_medians_of_distances_by_counts(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=(n, 2)), 1)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).mean(axis=2))[np.triu_indices(n, 1)]
    found = C.distance_medians(_frame(spark, x), "id", "pool", "v", block=20).first()
    assert (found.pairs, round(found.d50, 12)) == (int((d > 0).sum()), round(float(np.median(d[d > 0])), 12))


def test_label_sums_over_blocks(spark):
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    found = {(r.id // 3, r.other): (round(r.total, 9), r.n) for r in K.mean_distances(_frame(spark, x, labels=labels), "id", "v", "label", block=16).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    assert found == {(i, j): (round(float(d[i, labels == j].sum()), 9), int((labels == j).sum())) for i in range(90) for j in range(3)}


def test_copies_for_cells_are_never_broadcast(spark):
    x = np.random.default_rng(6).normal(size=(200, 2))
    rows = _frame(spark, x)
    plan = V.pairs(rows, "id", "pool", "v", dims=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_unrolled_distances_and_quick_rounding(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [4.0, 6.5]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, None], [2.0, 3.0])], "a array<double>, b array<double>")
    for f in V.METRICS.values():
        assert all(r.x == r.y for r in rows.select(f("a", "b").alias("x"), f("a", "b", 2).alias("y")).collect())
    assert all(r.x == r.y for r in rows.select(V.contributions("a", "b").alias("x"), V.contributions("a", "b", 2).alias("y")).where("x[0] is not null").collect())
    from pyspark.sql import functions as F

    assert [r.x for r in spark.createDataFrame([(0.0078125,), (1.23456749,), (None,)], "y double").select(V.rounded(F.col("y"), 6).alias("x")).collect()] == [0.007813, 1.234567, None]


def test_nearest_centre_is_compiled(spark):
    rows = spark.createDataFrame([([0.0, 1.0], [[5.0, 5.0], [0.0, 2.0], [0.0, 0.0]])], "v array<double>, centres array<array<double>>")
    near = rows.select(K._nearest(rows.v, rows.centres, 3, 2).alias("n"))
    assert tuple(near.first().n) == (1.0, 1)
    assert "lambda" not in near._jdf.queryExecution().executedPlan().toString()


def test_a_block_that_meets_itself_is_sent_once(spark):
    """Both sides see all rows of a pool of one block, from one copy of each."""
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(200)], "id long, pool int, v double")
    found = C.in_cells(rows, "id", ["pool"], ["v"], lambda a, b: {"n": [a.num_rows * b.num_rows], "once": [a.column("_side").to_pylist() == [C.BOTH] * 200]}, "n long, once boolean")
    assert [(r.n, r.once) for r in found.collect()] == [(200 * 200, True)]
