"""The registered queries against SQL where it can say them, else against the libraries they must equal."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.conftest import SF_DIR, comparable
from touchline.llm import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


def rows_of(spark, name):
    return [tuple(r) for r in registry.queries()[name](spark, SF_DIR).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF_DIR)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.columns, found.collect()) == comparable(columns, want.fetchall())


def test_bpe_equals_library(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert rows_of(spark, "op8_byte_bpe") == want


def test_token_files_equal_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(spark, "op10_token_files") == want


def test_language_held_out_accuracy(spark, duck):
    langs = dict(duck.execute("select doc_id, lang from documents").fetchall())
    found = [r for r in rows_of(spark, "op9_language_id") if r[1]]
    assert len(found) > 100 and all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in found)
    assert sum(langs[i] == lang for i, _, lang, _ in found) / len(found) > 0.98
    assert all(0 <= r[3] <= 1 for r in found)


def test_leaks_hold_every_verbatim_passage(spark, duck, texts):
    items = duck.execute("select item_id, text from benchmark").fetchall()
    plain = lambda t: " ".join(t.split())
    want = {(i, k) for i, t in texts for k, b in items if plain(b) in plain(t)}
    found = {(r.doc_id, r.item_id) for r in registry.queries()["op7_decontamination"](spark, SF_DIR).collect()}
    assert want and want <= found


def test_url_rules(spark):
    rows = registry.queries()["op3_url_filter"](spark, SF_DIR).collect()
    verdicts = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block", None: None}
    for r in rows:
        fits = [rule for rule in verdicts if rule and (r.host == rule.partition("/")[0] or r.host.endswith("." + rule.partition("/")[0])) and r.path.startswith("/" + rule.partition("/")[2])]
        assert r.rule == max(fits, key=len, default=None)
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
