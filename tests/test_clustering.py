import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import clustering as C


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -1]], float)
    labels = rng.integers(0, 3, 90)
    return centres[labels] + rng.normal(0, 0.8, (90, 3)), labels


@pytest.fixture(scope="module")
def table(spark, points):
    x, labels = points
    return spark.createDataFrame([(i, [float(a) for a in v], int(lab)) for i, (v, lab) in enumerate(zip(x, labels, strict=True))], "id long, v array<double>, label int").repartition(3)


def test_exact_resamples(spark, table):
    drawn = C.exact_resamples(table, "id", 5, 20, 0.8)
    assert {(r.run, r["count"]) for r in drawn.groupBy("run").count().collect()} == {(run, 72) for run in range(5, 25)}
    assert drawn.distinct().count() == 20 * 72
    tiny = C.exact_resamples(table.limit(3), "id", 0, 4, 0.5)
    assert {r["count"] for r in tiny.groupBy("run").count().collect()} == {1}
    assert C.exact_resamples(table.limit(1), "id", 0, 4, 0.5).count() == 0 and C.exact_resamples(table.limit(0), "id", 0, 4).count() == 0


def test_fits_find_the_planted_clusters_whatever_their_labels(table, points):
    members = C.with_runs(table, "id", "v", 4, 10)
    labels, reference = C.Fits(members, "id", 3, 3, 8).labels(4)
    named = {r.id: r.reference for r in reference.collect()}
    assert len({(named[i], lab) for i, lab in enumerate(points[1].tolist())}) == 3
    counts = C.contingency(labels, reference, "id")
    assert all(r.ari == pytest.approx(1) for r in C.rand_indices(counts).collect())
    same = C.agreement(labels, reference, "id", 3)
    assert same.where("not same").count() == 0 and same.groupBy("run").count().where("run >= 4 and count <> 72").count() == 0
    centres = [points[0][[i for i, n in named.items() if n == c]].mean(axis=0).tolist() for c in range(3)]
    assert centres == sorted(centres)


def test_alignment_maximises_overlap(spark):
    rng = np.random.default_rng(1)
    rows = [(run, int(a), int(b), int(rng.integers(0, 30))) for run in range(12) for a in range(4) for b in range(4)]
    found: dict[int, dict[int, int]] = {}
    for r in C.alignment(spark.createDataFrame(rows, "run int, reference int, label int, n long"), 4).collect():
        found.setdefault(r.run, {})[r.label] = r.aligned
    for run in range(12):
        n = np.zeros((4, 4), int)
        for _, a, b, c in (r for r in rows if r[0] == run):
            n[a, b] = c
        best = max(sum(n[p[b], b] for b in range(4)) for p in itertools.permutations(range(4)))
        assert sorted(found[run].values()) == [0, 1, 2, 3] and sum(n[a, b] for b, a in found[run].items()) == best
    with pytest.raises(ValueError):
        C.alignment(spark.createDataFrame(rows, "run int, reference int, label int, n long"), 7)


@pytest.mark.parametrize("block", [7, 2048])
def test_silhouettes(table, points, block):
    x, labels = points
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)
    for r in C.silhouettes(table, "id", "v", "label", block).collect():
        own = labels == labels[r.id]
        a = apart[r.id][own].sum() / (own.sum() - 1)
        b = min(apart[r.id][labels == other].mean() for other in range(3) if other != labels[r.id])
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


def test_silhouettes_of_single_rows_and_of_one_label(spark):
    rows = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1)], "id long, v array<double>, label int")
    assert {r.id: round(r.silhouette, 6) for r in C.silhouettes(rows, "id", "v", "label").collect()} == {1: 0.8, 2: 0.75, 3: 0.0}
    assert {r.silhouette for r in C.silhouettes(rows.where("label = 0"), "id", "v", "label").collect()} == {0.0}
    assert C.silhouettes(rows.limit(0), "id", "v", "label").count() == 0


def test_davies_bouldin_and_calinski_harabasz(table, points):
    x, labels = points
    c = np.array([x[labels == k].mean(axis=0) for k in range(3)])
    s = np.array([np.linalg.norm(x[labels == k] - c[k], axis=1).mean() for k in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert C.davies_bouldin(table, "v", "label", 3).first()[0] == pytest.approx(db)
    between = sum((labels == k).sum() * ((c[k] - x.mean(axis=0)) ** 2).sum() for k in range(3))
    within = sum(((x[labels == k] - c[k]) ** 2).sum() for k in range(3))
    assert C.calinski_harabasz(table, "v", "label", 3).first()[0] == pytest.approx((between / 2) / (within / 87))


@pytest.mark.parametrize("full", [True, False])
def test_mixture_equals_numpy(table, points, full):
    x, labels = points
    n, dims = x.shape
    r = np.eye(3)[labels]
    for step in range(4):
        w = r.sum(axis=0)
        mean = (r.T @ x) / w[:, None]
        cov = [np.einsum("n,ni,nj->ij", r[:, k], x - mean[k], x - mean[k]) / w[k] for k in range(3)]
        cov = [(c if full else np.diag(np.diag(c))) + 1e-6 * np.eye(dims) for c in cov]
        g = np.stack([np.log(w[k] / n) - 0.5 * (dims * np.log(2 * np.pi) + np.linalg.slogdet(cov[k])[1] + np.einsum("ni,ij,nj->n", x - mean[k], np.linalg.inv(cov[k]), x - mean[k])) for k in range(3)], axis=1)
        log_p = np.log(np.exp(g - g.max(axis=1, keepdims=True)).sum(axis=1)) + g.max(axis=1)
        r = np.exp(g - log_p[:, None])
        if step == 3:
            break
    mixture = C.Mixture(table, "v", "label", 3, dims, 3, full)
    row = mixture.information().first()
    p = 3 * (dims + (6 if full else 3)) + 2
    assert row.n == n and row.parameters == p and row.log_likelihood == pytest.approx(log_p.sum(), rel=1e-9)
    assert row.bic == pytest.approx(p * np.log(n) - 2 * log_p.sum(), rel=1e-9) and row.aic == pytest.approx(2 * p - 2 * log_p.sum(), rel=1e-9)
    given = {q.id: q.r for q in mixture.responsibilities().select("id", "r").collect()}
    assert all(np.allclose(given[i], r[i], atol=1e-8) for i in range(n)) and abs(sum(map(sum, given.values())) - n) < 1e-6


def test_an_empty_cluster_keeps_its_centre(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, v array<double>")
    labels, reference = C.Fits(C.with_runs(same, "id", "v", 2), "id", 2, 1, 3).labels(2)
    assert {r.label for r in labels.collect()} == {0} and reference.select(F.countDistinct("reference")).first()[0] == 1
