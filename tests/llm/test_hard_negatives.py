"""Hard negatives against all pairs with Python's integers."""

import math
import random

import pytest

from touchline.llm.op13_hard_negatives import LONG, hard_negatives, whole_numbers

SCHEMA = "vec_id long, label int, embedding array<float>, row int, dims string, kind string"


def brute(rows, is_anchor, positives=5, negatives=3, least=50, most=95):
    taken = []
    for i, label, x, *_ in rows:
        if i is not None and label is not None and x is not None and all(a is not None and math.isfinite(a) for a in x):
            taken.append((i, label, [math.floor(a * 256) if abs(a) < 2**44 else int(a) * 256 for a in x]))
    out = []
    for i, label, q in taken:
        if not is_anchor(i):
            continue
        scored = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, x, strict=True)))), j, other) for j, other, x in taken if j != i and len(x) == len(q)]
        for s, j, _ in sorted((r for r in scored if r[2] == label), key=lambda r: (-r[0], r[1]))[:positives]:
            fits = sorted((r for r in scored if r[2] != label and least * s <= 100 * r[0] <= most * s), key=lambda r: (-r[0], r[1]))[:negatives]
            out += [(i, j, rank, k, s, t) for rank, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, dims, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)  # one label holds more than a third
        rows.append((i, label, [round(0.4 * c + rng.gauss(0.3, 1), 3) for c in centres[label]]))
    return rows


def found(spark, rows, **sizes):
    import numpy as np

    rows = [(i, label, None if x is None else [None if a is None else float(np.float32(a)) for a in x]) for i, label, x in rows]
    table = spark.createDataFrame([(*r, 7, "other", "column") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hard_negatives(table, lambda i: i % 5 == 0, **sizes).collect()), brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("sizes", [{}, {"part": 30, "pack": 7, "block": 4}, {"part": 1, "pack": 1, "block": 1}])
def test_equals_all_pairs(spark, sizes):
    got, want = found(spark, vectors(1, 60 if sizes.get("part") == 1 else 160, 19), **sizes)
    assert got == want and len(want) > 30


def test_ties_copies_and_repeated_ids(spark):
    rows = vectors(2, 60, 6)
    rows += [(100 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(200 + i, 1 - min(rows[3][1], 1), rows[3][2]) for i in range(12)]
    rows += [(7, rows[7][1], rows[7][2]), (10, rows[10][1], rows[10][2]), (10, rows[10][1], rows[11][2])]
    got, want = found(spark, rows, part=25, pack=6, block=5)
    assert got == want and want


def test_rows_that_take_no_part(spark):
    rows = vectors(3, 40, 5)
    rows += [(None, 0, rows[0][2]), (500, None, rows[0][2]), (505, 1, None), (510, 1, [1.0, None, 1.0, 1.0, 1.0]), (515, 1, [math.nan] * 5), (520, 2, [math.inf] * 5)]
    rows += [(525, 1, []), (530, 1, []), (531, 2, []), (535, 0, [1.0, 2.0]), (540, 0, [2.0, 1.0]), (541, 3, [1.5, 1.0]), (545, 9, rows[1][2]), (550, -3, rows[1][2])]
    got, want = found(spark, rows, part=10, pack=4, block=3)
    assert got == want and {525, 535} <= {r[0] for r in want}


@pytest.mark.parametrize("size", [1e5, 1e8, 1e20, 3e38])
def test_large_components(spark, size):
    rows = [(i, label, [a * size if i % 2 else a for a in x]) for i, label, x in vectors(4, 40, 5)]
    got, want = found(spark, rows, part=10, pack=4, block=3)
    assert got == want and want


def test_whole_numbers():
    import numpy as np

    assert whole_numbers(np.array([[-0.001, 0.0039, 1.0]])).tolist() == [[-1.0, 0.0, 256.0]]
    assert whole_numbers(np.array([[1e308, -0.001]])).tolist() == [[int(1e308) * 256, -1]]


def test_empty_tables(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), lambda i: i % 5 == 0).collect() == []
    alone = spark.createDataFrame([(5, 1, [1.0]), (6, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives(alone, lambda i: i % 5 == 0).collect() == []
