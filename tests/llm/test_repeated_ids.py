"""An id that stands for different texts: each text is judged on its own."""

import random

from touchline.llm import op2_hyperminhash as op2


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    a, other = words(120), words(120)
    near = [*a[:60], "changed", *a[61:]]
    rows = [(1, " ".join(a)), (4, " ".join(near)), (4, " ".join(other)), (9, " ".join(other)), (9, " ".join(other)), (4, None), (7, ""), (None, " ".join(a)), (2, " ".join(words(50)))]
    found = op2.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)
    want = [(1, 116, 1, True), (4, 116, 1, False), (4, 116, 4, True), (9, 116, 4, False), (9, 116, 4, False), (4, 0, 4, True), (7, 0, 7, True), (None, 116, None, True), (2, 46, 2, True)]
    assert got == sorted(want, key=repr)
