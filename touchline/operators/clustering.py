"""Many clusterings in one job, the alignment of their labels, stability, and internal quality.

A fit is one Lloyd run: a run (a seed on all rows, or a resample) and one of its restarts. The fit is part of the key of every
aggregate, so no task holds the rows of a fit; only centres, ``fits * k`` vectors, come to the driver between rounds. Starts and
resamples follow from md5, so that every result is a function of the rows. Distances are compared after rounding to nine digits,
ties go to the smaller label; a cluster that loses all its rows keeps its centre.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import cells
from touchline.operators.similarity import rounded
from touchline.sources.scratch import stored

DIGITS = 9
MOST_CENTRES = 100_000
"""Centres that may come to the driver."""
MOST_LABELS = 6
"""Labels whose permutations are tried one by one."""
BUCKETS = 4096


def _md5(number: Column, key: str) -> Column:
    return F.md5(F.concat_ws(":", number.cast("string"), F.col(key).cast("string")).cast("binary"))


def exact_resamples(rows: DataFrame, key: str, first: int, n: int, share: float = 0.8) -> DataFrame:
    """(run, key): for each of ``n`` runs from ``first`` the floor(share * rows) keys of least md5. ``rows`` has distinct keys.

    The cut is found in counts of md5 prefixes; rows are ranked only inside the one prefix that it falls into.
    """
    hashed = rows.select(key, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("run")).withColumn("h", _md5(F.col("run"), key))
    hashed = hashed.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / (1 << 32) * BUCKETS))
    counts = hashed.groupBy("run", "bucket").agg(F.count("*").alias("n"))
    by_run = Window.partitionBy("run")
    cut = counts.withColumns({"upto": F.sum("n").over(by_run.orderBy("bucket")), "size": F.floor(F.sum("n").over(by_run) * share)})
    cut = cut.where((F.col("upto") >= F.col("size")) & (F.col("upto") - F.col("n") < F.col("size"))).select("run", F.col("bucket").alias("cut"), (F.col("size") - F.col("upto") + F.col("n")).alias("rest"))
    near = hashed.join(F.broadcast(cut), "run").where(F.col("bucket") <= F.col("cut"))  # a row per run
    inside = near.where(F.col("bucket") == F.col("cut")).withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("h", key))).where(F.col("r") <= F.col("rest"))
    return near.where(F.col("bucket") < F.col("cut")).select("run", key).unionAll(inside.select("run", key))


def with_runs(rows: DataFrame, key: str, vector: str, seeds: int, resamples: int = 0, share: float = 0.8) -> DataFrame:
    """(key, v, runs): the runs that each row takes part in: all of the first ``seeds``, and the resamples that drew it."""
    whole = rows.select(key, F.col(vector).alias("v"))
    every = F.sequence(F.lit(0), F.lit(seeds - 1))
    if not resamples:
        return stored(whole.withColumn("runs", every), "clustering-rows")
    drawn = exact_resamples(rows, key, seeds, resamples, share).groupBy(key).agg(F.sort_array(F.collect_list("run")).alias("drawn"))  # at most ``resamples``
    return stored(whole.join(drawn, key, "left").select(key, "v", F.concat(every, F.coalesce("drawn", F.array().cast("array<int>"))).alias("runs")), "clustering-rows")


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(v: Column, centres: Column, k: int, dims: int) -> Column:
    """(d, label) of the nearest centre, in plain arithmetic, which is compiled."""
    each = []
    for label in range(k):
        gaps = [F.get(v, F.lit(i)) - F.get(F.get(centres, F.lit(label)), F.lit(i)) for i in range(dims)]
        each.append(F.struct(rounded(reduce(lambda s, g: s + g * g, gaps, F.lit(0.0)), DIGITS).alias("d"), F.lit(label).alias("label")))
    return F.array_min(F.array(*each))


class Fits:
    """Lloyd fits of all runs: ``centres[fit]`` holds k vectors; fit = run * restarts + restart."""

    def __init__(self, members: DataFrame, key: str, k: int, restarts: int, rounds: int):
        self.members, self.key, self.k, self.restarts = members, key, k, restarts
        tasks = 2 * members.sparkSession.sparkContext.defaultParallelism  # the rows are few, their fits many
        self.expanded = members.repartition(tasks, key).select(key, "v", F.explode("runs").alias("run")).withColumn("fit", F.explode(F.sequence(F.col("run") * restarts, F.col("run") * restarts + restarts - 1)))
        first = Window.partitionBy("fit").orderBy("h", key)  # ranks of at most k rows leave a task
        chosen = self.expanded.withColumn("h", _md5(F.col("fit"), key)).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
        self.centres: dict[int, np.ndarray] = {}
        for row in sorted(chosen.select("fit", "r", "v").limit(MOST_CENTRES).collect(), key=lambda r: (r.fit, r.r)):
            self.centres[row.fit] = np.vstack([self.centres[row.fit], row.v]) if row.fit in self.centres else np.array([row.v])
        self.centres = {f: c for f, c in self.centres.items() if len(c) == k}
        for _ in range(rounds if self.centres else 0):
            self._step()

    def table(self) -> DataFrame:
        rows = [(f, [[float(x) for x in v] for v in c]) for f, c in sorted(self.centres.items())]
        return F.broadcast(self.members.sparkSession.createDataFrame(rows, "fit int, centres array<array<double>>"))  # fits * k vectors

    def near(self) -> DataFrame:
        """(fit, run, key, v, d, label) of every row in every fit."""
        dims = len(next(iter(self.centres.values()))[0]) if self.centres else 0
        return self.expanded.join(self.table(), "fit").withColumn("near", _nearest(F.col("v"), F.col("centres"), self.k, dims)).select("fit", "run", self.key, "v", "near.d", "near.label")

    def _step(self) -> None:
        dims = len(next(iter(self.centres.values()))[0])
        sums = self.near().groupBy("fit", "label").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
        self.centres = {f: c.copy() for f, c in self.centres.items()}
        for row in sums.collect():  # fits * k rows
            self.centres[row.fit][row.label] = [row[f"s{i}"] / row.n for i in range(dims)]

    def best(self) -> DataFrame:
        """(run, fit, inertia): the fit of least inertia of each run, the first among equals."""
        inertia = self.near().groupBy("run", "fit").agg(F.round(F.sum("d"), 6).alias("inertia"))
        return inertia.groupBy("run").agg(F.min(F.struct("inertia", "fit")).alias("m")).select("run", "m.fit", "m.inertia")

    def labels(self, seeds: int) -> tuple[DataFrame, DataFrame]:
        """(run, key, label) of the best fit of each run, and (key, reference): the best fit of the first ``seeds`` runs with labels in the order of its centres."""
        best = self.best().collect()  # a row per run
        chosen = {r.run: r.fit for r in best}
        spark = self.members.sparkSession
        kept = F.broadcast(spark.createDataFrame([(f,) for f in sorted(chosen.values())], "fit int"))  # as many rows as runs
        found = stored(self.near().join(kept, "fit").select("fit", "run", self.key, "label"), "clustering-labels")
        _, base = min((r.inertia, r.fit) for r in best if r.run < seeds)
        order = canonical_order(self.centres[base])
        rename = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(self.k)]), F.col("label") + 1)
        return found.select("run", self.key, "label"), found.where(F.col("fit") == base).select(self.key, rename.alias("reference"))


def canonical_order(centres: np.ndarray) -> list[int]:
    """Labels in the lexicographic order of their centres."""
    return sorted(range(len(centres)), key=lambda i: tuple(np.round(centres[i], DIGITS).tolist()))


def contingency(labels: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(run, reference, label, n)."""
    return labels.join(reference, key).groupBy("run", "reference", "label").agg(F.count("*").alias("n"))


def alignment(counts: DataFrame, k: int) -> DataFrame:
    """(run, label, aligned): the renaming of labels under which most rows of a run agree with the reference; the first permutation among equals."""
    if k > MOST_LABELS:
        raise ValueError(f"permutations of {k} labels are too many; at most {MOST_LABELS}")
    orders = list(itertools.permutations(range(k)))
    table = counts.sparkSession.createDataFrame([(p, i, a) for p, order in enumerate(orders) for i, a in enumerate(order)], "p int, label int, aligned int")
    table = F.broadcast(table)  # k * k! rows
    agreed = counts.join(table, "label").groupBy("run", "p").agg(F.sum(F.when(F.col("reference") == F.col("aligned"), F.col("n")).otherwise(0)).alias("agreed"))
    best = agreed.groupBy("run").agg(F.min(F.struct((-F.col("agreed")).alias("minus"), "p")).alias("m")).select("run", "m.p")
    return best.join(table, "p").select("run", "label", "aligned")


def rand_indices(counts: DataFrame) -> DataFrame:
    """(run, ari): the adjusted Rand index of each run with the reference."""
    two = lambda c: c * (c - 1) / 2
    side = lambda by: counts.groupBy("run", by).agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(two(F.col("n"))).alias(f"by_{by}"), two(F.sum("n")).alias(f"all_{by}"))
    joined = counts.groupBy("run").agg(F.sum(two(F.col("n"))).alias("both")).join(side("reference"), "run").join(side("label"), "run")
    expected = F.try_divide(F.col("by_reference") * F.col("by_label"), F.col("all_label"))
    return joined.select("run", F.coalesce(F.try_divide(F.col("both") - expected, (F.col("by_reference") + F.col("by_label")) / 2 - expected), F.lit(1.0)).alias("ari"))


def agreement(labels: DataFrame, reference: DataFrame, key: str, k: int) -> DataFrame:
    """(run, key, reference, same): each row of each run, and whether its aligned label is that of the reference."""
    joined = labels.join(reference, key)
    names = alignment(contingency(labels, reference, key), k)
    return joined.join(F.broadcast(names), ["run", "label"]).select("run", key, "reference", (F.col("aligned") == F.col("reference")).alias("same"))  # k rows per run


# Internal quality ------------------------------------------------------------------------------------------------------


def mean_distances(rows: DataFrame, key: str, vector: str, label: str, block: int = cells.BLOCK) -> DataFrame:
    """(key, label, other, total, n): for each row and label the sum of its Euclidean distances to the rows of that label.

    Rows lie in blocks; a pair of blocks is one cell of a join, whose sums per row and label are merged.
    """
    sums = cells.label_sums(rows, key, vector, label, block)
    return sums.select(F.col("left_id").alias(key), F.col("own").alias(label), "other", "total", "n")


def silhouettes(rows: DataFrame, key: str, vector: str, label: str, block: int = cells.BLOCK) -> DataFrame:
    """(key, label, silhouette): 0 for the only row of a label and where there is one label."""
    own = F.col("other") == F.col(label)
    each = mean_distances(rows, key, vector, label, block).groupBy(key, label).agg(
        F.max(F.when(own, F.try_divide(F.col("total"), (F.col("n") - 1).cast("double")))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    return each.select(key, label, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def _centres(rows: DataFrame, vector: str, label: str, dims: int) -> DataFrame:
    return rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(dims)]).alias("c"))


def davies_bouldin(rows: DataFrame, vector: str, label: str, dims: int) -> DataFrame:
    """One row: the mean over labels of the worst (spread + spread) / distance of centres."""
    centres = _centres(rows, vector, label, dims)
    spread = rows.join(F.broadcast(centres), F.col(label) == F.col("l")).groupBy("l").agg(F.avg(F.sqrt(squared(F.col(vector), F.col("c")))).alias("s"), F.first("c").alias("c"))  # a centre per label
    a, b = spread.select(F.col("l").alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), spread.select(F.col("l").alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    pairs = a.join(F.broadcast(b), F.col("i") != F.col("j"))  # labels, not rows
    worst = pairs.groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), F.sqrt(squared(F.col("ci"), F.col("cj"))))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, vector: str, label: str, dims: int) -> DataFrame:
    """One row: between-cluster over within-cluster variance, each by its degrees of freedom."""
    whole = rows.agg(F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(dims)]).alias("m"))
    centres = _centres(rows, vector, label, dims)
    between = centres.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared(F.col("c"), F.col("m"))).alias("between"), F.count("*").alias("k"), F.sum("n").alias("rows"))  # one row
    within = rows.join(F.broadcast(centres), F.col(label) == F.col("l")).agg(F.sum(squared(F.col(vector), F.col("c"))).alias("within"))  # a centre per label
    ratio = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("rows") - F.col("k")))
    return between.crossJoin(within).select(ratio.alias("calinski_harabasz"))  # one row each


# Gaussian mixtures -----------------------------------------------------------------------------------------------------


class Mixture:
    """A Gaussian mixture by EM from given labels; sums of responsibilities come from Spark, the k small matrices are inverted on the driver."""

    def __init__(self, rows: DataFrame, vector: str, label: str, k: int, dims: int, rounds: int, full: bool = True, ridge: float = 1e-6):
        self.rows, self.vector, self.k, self.dims, self.full, self.ridge = rows, vector, k, dims, full, ridge
        start = F.array(*[F.when(F.col(label) == j, 1.0).otherwise(0.0) for j in range(k)])
        self._maximise(rows.withColumn("r", start))
        for _ in range(rounds):
            self._maximise(self.responsibilities())

    def _pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.dims) for j in range(i if self.full else i, self.dims if self.full else i + 1)]

    def _maximise(self, weighted: DataFrame) -> None:
        x = [F.get(F.col(self.vector), F.lit(i)) for i in range(self.dims)]
        each = weighted.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.posexplode("r").alias("j", "w"))
        weight = F.col("w")
        sums = each.groupBy("j").agg(
            F.sum(weight).alias("w"), *[F.sum(weight * F.col(f"x{i}")).alias(f"m{i}") for i in range(self.dims)], *[F.sum(weight * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"q{a}_{b}") for a, b in self._pairs()]
        )
        found = {r.j: r for r in sums.collect()}  # k rows
        total = sum(r.w for r in found.values())
        self.weights, self.means, self.covariances = np.zeros(self.k), np.zeros((self.k, self.dims)), np.zeros((self.k, self.dims, self.dims))
        for j, r in found.items():
            w = max(r.w, 10 * np.finfo(float).eps)
            self.weights[j] = r.w / total
            self.means[j] = [r[f"m{i}"] / w for i in range(self.dims)]
            for a, b in self._pairs():
                self.covariances[j, a, b] = self.covariances[j, b, a] = r[f"q{a}_{b}"] / w - self.means[j, a] * self.means[j, b]
            self.covariances[j] += self.ridge * np.eye(self.dims)

    def _log_densities(self) -> Column:
        x = [F.get(F.col(self.vector), F.lit(i)) for i in range(self.dims)]
        out = []
        for j in range(self.k):
            precision, logdet = np.linalg.inv(self.covariances[j]), np.linalg.slogdet(self.covariances[j])[1]
            gap = [c - F.lit(float(m)) for c, m in zip(x, self.means[j], strict=True)]
            form = sum((gap[a] * gap[b] * float(precision[a, b] * (1 if a == b else 2)) for a, b in self._pairs()), F.lit(0.0))
            out.append(F.lit(float(np.log(max(self.weights[j], 1e-300)) - (self.dims * np.log(2 * np.pi) + logdet) / 2)) - form / 2)
        return F.array(*out)

    def _scored(self) -> DataFrame:
        logs = self.rows.withColumn("g", self._log_densities()).withColumn("top", F.array_max("g"))
        return logs.withColumn("log_p", F.col("top") + F.log(F.aggregate("g", F.lit(0.0), lambda s, g: s + F.exp(g - F.col("top")))))

    def responsibilities(self) -> DataFrame:
        """The rows with ``r``: the probability of each component."""
        return self._scored().withColumn("r", F.transform("g", lambda g: F.exp(g - F.col("log_p")))).drop("g", "top", "log_p")

    def parameters(self) -> int:
        per = self.dims * (self.dims + 1) // 2 if self.full else self.dims
        return self.k * (self.dims + per) + self.k - 1

    def information(self) -> DataFrame:
        """One row: n, parameters, log_likelihood, bic, aic."""
        p = F.lit(self.parameters())
        one = self._scored().agg(F.count("*").alias("n"), F.sum("log_p").alias("log_likelihood"))
        return one.select("n", p.alias("parameters"), "log_likelihood", (p * F.log("n") - 2 * F.col("log_likelihood")).alias("bic"), (2 * p - 2 * F.col("log_likelihood")).alias("aic"))
