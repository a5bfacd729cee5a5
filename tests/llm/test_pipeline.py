"""The pipeline's stages against brute force on the small tables."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF_DIR
from touchline.llm.op2_hyperminhash import _shingle_set


def test_stages(spark):
    assert [name for name, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "tokens"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(400).persist()
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 0), (None, "the and of thing reheard", None, None, None)], docs.schema))
    kept = P.language(spark, docs, SF_DIR)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == P.COLUMNS and not ids & {9001, 9002} and len(ids) == 401 and kept.where("lang is null").count() == 0
    before = {r.doc_id: r.text for r in kept.collect()}
    single = P.near_dedup(spark, kept, SF_DIR)
    after = {r.doc_id: r.text for r in single.collect()}
    sets = {i: _shingle_set(t, 5) for i, t in after.items() if i is not None}
    assert all(len(a & b) * 100 < 80 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and (a & b))
    gone = set(before) - set(after)
    assert all(any(len((s := _shingle_set(before[g], 5)) & _shingle_set(t, 5)) * 100 >= 80 * len(s | _shingle_set(t, 5)) for i, t in before.items() if i != g) for g in gone)
    clean = P.decontaminate(spark, single, SF_DIR)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    assert all((i in left) == (not any(b in " ".join(t.split()) for b in items)) or i not in left for i, t in after.items())
    assert not any(b in " ".join(t.split()) for t in left.values() for b in items)
    hidden = P.secrets(spark, clean, SF_DIR)
    assert hidden.count() == clean.count() and hidden.where("text rlike 'AKIA[A-Z0-9]{16,}'").count() == 0
    coded = P.tokens(spark, hidden, SF_DIR)
    assert coded.count() == hidden.count() and coded.where("not round_trip").count() == 0


def test_near_dedup_leaves_one_row_of_a_group(spark):
    words = {c: [f"{c}{i}" for i in range(60)] for c in "abcde"}
    near = {c: " ".join([*w[:-1], "x"]) for c, w in words.items()}
    text = {c: " ".join(w) for c, w in words.items()}
    rows = [(1, text["a"]), (1, text["a"]), (2, near["a"]), (3, text["b"]), (3, near["b"]), (None, text["c"]), (None, text["c"]), (None, near["c"]), (None, text["d"]), (9, near["d"]), (4, text["e"])]
    wordless = [(5, None), (5, None), (None, None), (None, ""), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows + wordless)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_dedup(spark, docs, SF_DIR)
    assert kept.columns == P.COLUMNS
    found = [(r.doc_id, r.text) for r in kept.collect()]
    left = [(i, t) for i, t in found if t and t.strip()]
    assert sorted(t[0] for _, t in left) == ["a", "b", "c", "d", "e"] and {t[0]: i for i, t in left} == {"a": 1, "b": 3, "c": None, "d": 9, "e": 4}
    assert set(left) <= set(rows) and sorted(map(repr, set(found) - set(left))) == sorted(map(repr, set(wordless))) and len(found) == 10


def test_run(spark):
    assert P.run(spark, SF_DIR.replace("sf0.01", "sf0.001")).count() > 0


def test_language_rejects_texts_unlike_every_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(9001, "Ω ψυχή δεν είναι εδώ και τώρα " * 20, "en"), (9002, "zxqj vkwz qqxz jjwk " * 30, None), (9003, "Edrere.", "en")]
    own = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], docs.schema)
    kept = P.language(spark, docs.unionByName(own), SF_DIR)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {9001, 9002} and 9003 in ids and len(ids) >= 0.995 * docs.count()
    unlabelled = own.withColumn("lang", F.lit(None).cast("string"))
    assert P.language(spark, unlabelled, SF_DIR).count() == 3 and P.language(spark, docs.where("false"), SF_DIR).count() == 0


def test_stages_of_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
