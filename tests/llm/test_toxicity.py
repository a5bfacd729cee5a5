"""Automata against plain edit distances; learning and scoring on small tables and held-out rows."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import op11_toxicity as op11

TERMS = [("moron", False), ("pathetic", False), ("disgusting", False), ("scum", False), ("achlich", True), ("bomenteco", True), ("mor", True)]


def distance(word, term, stem):
    """Edits from the term to the word, or to the nearest beginning of it."""
    row = list(range(len(word) + 1))
    for i, c in enumerate(term, 1):
        row, above = [i], row
        for j, d in enumerate(word, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d)))
    return min(row) if stem else row[-1]


def expected(word, terms):
    fits = [(e, -len(t), (t, s), i) for i, (t, s) in enumerate(terms) if (e := distance(word, t, s)) <= op11.errors_of(t, s)]
    return (min(fits)[3], min(fits)[0]) if fits else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="mornpathecilg", min_size=1, max_size=24), min_size=1, max_size=20))
def test_automata_on_any_words(words):
    assert op11.Trie(TERMS).match(words) == [expected(w, TERMS) for w in words]


def test_automata_on_misspelled_terms():
    rng, words = random.Random(11), []
    for _ in range(800):
        w = list(rng.choice(TERMS)[0] + rng.choice(["", "", "s", "ung", "x" * 80]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "o", "é", "😀"])
        words.append("".join(w) or "a")
    found = op11.Trie(TERMS).match(words)
    assert found == [expected(w, TERMS) for w in words]
    assert {f[1] for f in found if f} == {0, 1, 2}
    assert op11.Trie([]).match(["a"]) == [None]


def corpus(spark, n=240, extra=()):
    rng, rows, labels = random.Random(5), [], []
    plain = ["river", "stone", "garden", "oron", "letter", "window", "summer"]
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        if toxic:
            for term in ("moron", "pathetic", "lowei" + rng.choice(["ung", "heit", "ig"])):
                words[rng.randrange(40)] = term
        rows.append((i, " ".join(words), "x", 1.5, 1))
        labels.append((i, int(toxic), 1))
    rows += list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def model(spark):
    return op11.fit(*corpus(spark))


def scores(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "z", 2.5) for i, t in enumerate(texts)], "doc_id long, text string, n_hits string, score double")
    found = op11.score(docs, model)
    assert found.columns == ["doc_id", "text", *op11.OUTPUTS]
    return sorted(found.collect(), key=lambda r: r.doc_id)


def test_lexicon_and_exceptions(model):
    assert {("moron", False), ("pathetic", False)} <= set(model.terms) and any("lowei".startswith(t) and s for t, s in model.terms)
    assert not any(t.startswith(p) for t, _ in model.terms for p in ("river", "stone", "oron"))
    assert "oron" in model.exceptions


def test_misspelled_quoted_and_clean(spark, model):
    plain = "the river and the stone in the garden of the window "
    texts = [plain * 4, plain + "moron pathetic moron", plain + "mor0n pathettic moran", plain + "oron oron oron", plain + 'he wrote "you moron pathetic moron" there', "", None, "... !!", "moron " * 9000]
    r = scores(spark, model, texts)
    assert [x.predicted for x in r[:2]] == [0, 1] and r[8].predicted == 1
    assert r[2].n_hits == r[2].n_fuzzy == 3 and r[0].score < r[2].score < r[1].score
    assert r[3].n_hits == 0 and r[3].predicted == 0
    assert r[4].n_quoted == 3 and r[4].score < r[1].score
    assert [x.score for x in r[5:8]] == [r[0].score] * 3 and all(0 <= x.score <= 1 for x in r)


def test_copies_share_a_vote(spark):
    rng = random.Random(6)
    words = [f"harmless{rng.choice('abcdefgh')}{i}" for i in range(60)] + ["pathetic"] * 3
    copies = []
    for i in range(120):
        w = list(words)
        w[rng.randrange(60)] = f"edit{i}"
        copies.append((1000 + i, " ".join(w), "x", 1.0, 0))
    docs, labels = corpus(spark, 240, copies)
    more = labels.union(spark.createDataFrame([(1000 + i, 1, 1) for i in range(120)], labels.schema))
    assert not any(t.startswith("harm") or "harmless".startswith(t) for t, _ in op11.fit(docs, more).terms)


def test_labels_of_all_kinds(spark):
    docs, labels = corpus(spark, 80, [(None, "moron", "x", 1.0, 0), (3, "other text", "x", 1.0, 0), (3, None, "x", 1.0, 0)])
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, 1), (4, 1, 1), (4, 1, 0), (99999, 1, 1)], labels.schema))
    assert ("moron", False) in op11.fit(docs, odd).terms
    one = op11.fit(docs, labels.where("toxic = 0"))
    assert one.terms == [] and scores(spark, one, ["moron"])[0].score < 0.05
    none = op11.fit(docs, labels.limit(0))
    assert scores(spark, none, ["moron", None])[1].score == 0.5
    assert op11.score(docs.limit(0), none).count() == 0
    assert op11.fit(docs.limit(0), labels).terms == []


def test_bound_of_training_rows(spark):
    docs, labels = corpus(spark, 240)
    assert 20 < op11.training_rows(docs, labels, 60).count() <= 60


def test_held_out_rows(spark):
    """sf0.1: what carries no term (junk made of toxic texts, labelled like them) can't be found."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = op11.op11(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    judged = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    hits = sum(a and b for a, b in judged)
    assert hits / sum(b for _, b in judged) > 0.97 and hits / sum(a for a, _ in judged) > 0.9
