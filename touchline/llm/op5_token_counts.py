r"""Token counts of sections by offset mapping.

A document is encoded once, as a whole. Each token has a span of the text; sections are intervals of it, by default its lines (a line
keeps its ``\n``). An interval join of the two sorted lists gives each token to sections by one of these rules:
``start`` (default): to the section that holds its first byte; ``end``: its last byte; ``most``: the section that holds most of its bytes, the earliest
of equals; ``share``: to each section it touches, in proportion to its bytes. Under every rule the counts of a document's sections add up to its tokens.

Edge cases: a null or empty text has one empty section without tokens; ids may be null or repeat, rows are independent; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from touchline.llm.common import documents, text_chunks
from touchline.llm.tokens import definition_at, encoder_of


def shares(token_start: np.ndarray, token_end: np.ndarray, section_start: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Spans and sections are sorted, and sections cover the text without gaps."""
    n = len(section_start)
    head = np.searchsorted(section_start, token_start, "right") - 1
    tail = np.searchsorted(section_start, token_end - 1, "right") - 1
    if rule == "start":
        return np.bincount(head, minlength=n).astype(np.float64)
    if rule == "end":
        return np.bincount(tail, minlength=n).astype(np.float64)
    whole = head == tail
    found = np.bincount(head[whole], minlength=n).astype(np.float64)
    for i in np.flatnonzero(~whole):
        touched = np.arange(head[i], tail[i] + 1)
        until = np.append(section_start[touched[1:]], token_end[i])
        part = until - np.maximum(section_start[touched], token_start[i])
        if rule == "most":
            found[touched[part.argmax()]] += 1
        else:
            found[touched] += part / part.sum()
    return found


def _attribute(definition: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition)
        lengths = encoder.byte_lengths()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                size = lengths[encoder.encode_many(data, offsets)[0]]
                ends = np.cumsum(size)
                # a line begins at each text and after each newline that doesn't end its text
                breaks = np.flatnonzero(data == 10) + 1
                starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
                counts = shares(ends - size, ends, starts, rule) if len(starts) else np.zeros(0)
                doc = np.searchsorted(offsets, starts, "right") - 1
                empty = np.flatnonzero(np.diff(offsets) == 0)
                # characters: bytes that don't continue one
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                stop = np.append(starts[1:], len(data)) if len(starts) else starts
                base = chars[offsets[doc]]
                columns = [np.concatenate([doc, empty]), np.concatenate([chars[starts] - base, empty * 0]), np.concatenate([chars[stop] - base, empty * 0]), np.concatenate([counts, empty * 0.0])]
                by = np.lexsort((columns[1], columns[0]))
                doc, begin, end, counts = (c[by] for c in columns)
                first = np.searchsorted(doc, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc + lo)), pa.array(np.arange(len(doc)) - first[doc], pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(counts, pa.float64())],
                    names=["doc_id", "section", "start_char", "end_char", "tokens"],
                )

    return run


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start") -> DataFrame:
    """doc_id, section (from 0), start_char, end_char, tokens: a row for each line of each document."""
    if rule not in ("start", "end", "most", "share"):
        raise ValueError(f"unknown rule: {rule}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_attribute(tokenizer, rule), f"doc_id {kind}, section long, start_char long, end_char long, tokens double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir), definition_at(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op5_token_counts": op5}
