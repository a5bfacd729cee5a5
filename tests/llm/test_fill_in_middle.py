"""Cuts, forms and round trips of rearranged texts against a plain version over code points."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm.op12_fill_in_middle import Units, fill_in_middle, restored


def plain_version(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, middle, rest = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(before), len(middle), f"<S>{rest}<P>{before}<M>{middle}"
    return n, "psm", len(before), len(middle), f"<P>{before}<S>{rest}<M>{middle}"


def some_texts():
    rng = random.Random(12)
    odd = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb\r", "<P>", "x <M> y\nz", "<\nP>", "ends in <", "S>\nP>\n<", "é\nß\n漢字\n😀", "x" * 20000, "\n" * 9000, "ä" * 5000 + "\n" + "😀" * 3000]
    return odd + ["".join(rng.choice(["\n", "a", "é", "漢", "😀", "<", ">", "P"]) for _ in range(rng.randint(1, 400))) for _ in range(80)]


@pytest.mark.parametrize(("block", "rate", "spm_rate"), [(4096, 100, 50), (1, 60, 0), (7, 60, 100)])
def test_equals_plain_version(spark, block, rate, spm_rate):
    texts = some_texts()
    rows = [(i if i != 20 else None, t, "kept", 1, "gone") for i, t in enumerate(texts)] + [(3, "other\ntext", "kept", 1, "gone"), (3, "other\ntext", "kept", 1, "gone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h1 string, n int, form string").repartition(3)
    found = fill_in_middle(docs, rate=rate, spm_rate=spm_rate, block=block)
    assert found.columns == ["doc_id", "text", "_h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(([r.doc_id, r.text, r._h1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output] for r in found.collect()), key=repr)
    assert got == sorted(([i, t, "kept", *plain_version(i, t, 7, rate, spm_rate)] for i, t, *_ in rows), key=repr)
    again = found.select(F.coalesce("text", F.lit("")).alias("text"), restored().alias("restored")).collect()
    assert all(r.text == r.restored for r in again) and len(again) == len(rows)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\na漢😀", max_size=60), st.integers(1, 9))
def test_cuts(text, block):
    raw = text.encode()
    units, lines = Units(np.frombuffer(raw, np.uint8), block), re.findall(r"[^\n]*\n|[^\n]+", text)
    assert units.n == len(lines)
    for k in range(len(lines) + 1):
        whole = "".join(lines[:k])
        assert units.cut(k) == len(whole.encode()) and units.chars(units.cut(k)) == len(whole)
