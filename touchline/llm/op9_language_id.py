"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds three of them, each permuted by its place;
a text bundles (adds) the vectors of its trigrams; a language's prototype bundles the unit vectors of its
labelled texts. A text gets the language whose prototype has the largest cosine with it.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from, every
text is ``und``; equal cosines go to the alphabetically first language; rows that repeat an id each get a row.
Only text is used for a prediction, and only rows outside the held-out fold for learning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import crc_fold, documents, mixed, text_chunks

DIMENSIONS = 1024
SCALE = 1 << 20
"""Unit vectors are bundled as integers of this scale, so that a sum doesn't depend on its order."""
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """Rows of +1 and -1, a function of the code point alone."""
    keys = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dims // 64, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mixed(mixed(keys + np.uint64(0x51ED27))).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, points: np.ndarray, dims: int) -> np.ndarray:
    """Bound vectors of trigrams given as places in ``points``; the place in the trigram permutes the letter's vector."""
    base = letter_vectors(points, dims)
    return (np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]).astype(np.float32)


def text_vectors(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of consecutive texts, and whether each has a letter."""
    raw = data.tobytes()
    texts = [f" {raw[a:b].decode('utf-8', 'replace').lower()} " for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.where(_letters()[points], points, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    has = np.bincount(doc[codes != 32], minlength=len(texts)) > 0
    vectors = np.zeros((len(texts), dims), np.float32)
    if len(codes) < 3:
        return vectors, has
    seen = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(seen[-1]) + 1, np.int64)
    place[seen] = np.arange(len(seen))
    p, k = place[codes], len(seen)
    whole = doc[2:] == doc[:-2]
    gram, owner = (((p[:-2] * k) + p[1:-1]) * k + p[2:])[whole], doc[2:][whole]
    if not len(gram):
        return vectors, has
    if k**3 <= 4_000_000:
        grams = np.flatnonzero(np.bincount(gram, minlength=k**3))
        where = np.zeros(k**3, np.int64)
        where[grams] = np.arange(len(grams))
        gram = where[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    step = 4096  # trigrams bound at once
    for lo in range(0, len(grams), step):
        some = grams[lo : lo + step]
        mine = (gram >= lo) & (gram < lo + step) if len(grams) > step else slice(None)
        counts = np.bincount(owner[mine] * len(some) + gram[mine] - lo, minlength=len(texts) * len(some)).reshape(len(texts), -1)
        vectors += counts.astype(np.float32) @ trigram_vectors(some // (k * k), some // k % k, some % k, seen, dims)
    return vectors, has


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64)))
    return vectors / np.where(norm > 0, norm, 1)[:, None]


def _bundle(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in text_chunks(batch, size=500_000):
                vectors, has = text_vectors(data, offsets, dims)
                whole = np.rint(unit(vectors) * SCALE).astype(np.int64)
                names = np.array(langs[lo:hi], object)
                for lang in set(langs[lo:hi]):
                    if (mine := (names == lang) & has).any():
                        sums[lang] = sums.get(lang, 0) + whole[mine].sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "dim": np.arange(dims, dtype=np.int32), "value": v})

    return run


def prototypes(labelled: DataFrame, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> unit prototype; as many numbers as languages times ``dims`` come to the driver."""
    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(_bundle(dims), "lang string, dim int, value long")
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    found: dict[str, np.ndarray] = {}
    for lang, dim, value in rows:
        found.setdefault(lang, np.zeros(dims))[dim] = value
    return {k: unit(v[None, :])[0] for k, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dims: int = DIMENSIONS) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; rows pass through one task each, nothing is shuffled."""
    names = list(profiles)
    matrix = np.stack([profiles[k] for k in names]).astype(np.float32) if names else np.zeros((0, dims), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, size=500_000):
                vectors, has = text_vectors(data, offsets, dims)
                langs, scores = ["und"] * (hi - lo), np.zeros(hi - lo)
                if names:
                    cosines = np.round((unit(vectors).astype(np.float32) @ matrix.T).astype(np.float64), 5)
                    best = cosines.argmax(axis=1)
                    scores = np.where(has, np.clip(cosines[np.arange(hi - lo), best], 0, 1), 0.0)
                    langs = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double"
    return docs.select(*kept).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)))
    profiles = prototypes(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language_id": op9}
