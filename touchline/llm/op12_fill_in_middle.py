"""Fill-in-the-middle: texts are cut at two unit boundaries and put together anew as prefix-suffix-middle or suffix-prefix-middle.

A unit is a line, ``[^\\n]*\\n|[^\\n]+``. Which boundaries are cut and which form a text takes follow from a hash of
its id alone. Each text is laid out in blocks of ``BLOCK`` bytes; a Fenwick tree over the blocks holds their counts of
line ends and of code points. A cut is found by descending the tree by binary lifting to its block and looking for the
line end there; code points before it are a prefix sum of the tree and a count inside that block. Every row is its own
job, so nothing is shuffled. ``restored`` rebuilds the text from output and form with string functions alone.

Edge cases: a null text is empty; an empty text, and one that holds a marker, is left as it is (``plain``); a null id
hashes like an empty one; rows that repeat an id are cut by the same hashes, each by its own number of lines; an empty
table gives no row; columns of ``docs`` named like an output column are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, text_chunks

BLOCK = 4096
MARKERS = ("<P>", "<S>", "<M>")
OUTPUTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


class Fenwick:
    """Prefix sums of block counts, and the block in which a running count is reached."""

    def __init__(self, counts: np.ndarray):
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.arange(len(upto))
        self.tree = upto - upto[at - (at & -at)]  # node i sums the i & -i blocks that end with block i
        self.total = int(upto[-1])

    def before(self, block: int) -> int:
        """The sum over the first ``block`` blocks."""
        total = 0
        while block:
            total += int(self.tree[block])
            block &= block - 1
        return total

    def reach(self, k: int) -> tuple[int, int]:
        """(block, rest): the ``k``-th counted thing is the ``rest``-th of that block; 1 <= k <= total."""
        block, size = 0, len(self.tree) - 1
        step = 1 << max(size, 1).bit_length() - 1
        while step:
            if block + step <= size and self.tree[block + step] < k:
                block += step
                k -= int(self.tree[block])
            step >>= 1
        return block, k


class Units:
    """The lines of one text."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.ends = Fenwick(count(data == 10))
        self.points = Fenwick(count((data & 0xC0) != 0x80))
        self.n = self.ends.total + int(len(data) > 0 and data[-1] != 10)

    def cut(self, k: int) -> int:
        """The byte at which the first ``k`` units end."""
        if k == 0:
            return 0
        if k > self.ends.total:
            return len(self.data)
        block, rest = self.ends.reach(k)
        lo = block * self.block
        return lo + int(np.flatnonzero(self.data[lo : lo + self.block] == 10)[rest - 1]) + 1

    def chars(self, byte: int) -> int:
        """Code points before ``byte``."""
        block = byte // self.block
        return self.points.before(block) + int(np.count_nonzero((self.data[block * self.block : byte] & 0xC0) != 0x80))


def _hashes(id_col: str, seed: int, names: list[str]) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(names)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, block: int = BLOCK) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if plain) and output.

    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of these in the form suffix-prefix-middle.
    """
    p, s, m = (x.encode() for x in MARKERS)
    longest = max((len(c) for c in docs.columns), default=0)
    names = [f"{'h' * longest}{i}" for i in range(1, 5)]  # longer than any column of the caller

    def rearranged(data: np.ndarray, h: tuple[int, ...]) -> tuple:
        raw, units = data.tobytes(), Units(data, block)
        if not raw or p in raw or s in raw or m in raw or h[2] % 100 >= rate:
            return units.n, "plain", None, None, raw
        a, b = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
        a, b = units.cut(a), units.cut(b)
        before = units.chars(a)
        middle = units.chars(b) - before
        if h[3] % 100 < spm_rate:
            return units.n, "spm", before, middle, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
        return units.n, "psm", before, middle, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = list(zip(*(batch.column(name).to_pylist() for name in names), strict=True))
            for lo, hi, data, offsets in text_chunks(batch, text_col):
                found = [rearranged(data[a:b], h) for a, b, h in zip(offsets[:-1], offsets[1:], hashes[lo:hi], strict=True)]
                part = batch.slice(lo, hi - lo).drop_columns(names)
                n, form, before, middle, output = zip(*found, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *OUTPUTS])

    rows = docs.select(*[c for c in docs.columns if c not in OUTPUTS or c in (id_col, text_col)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("*", *_hashes(id_col, seed, names)).mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of: a text with a marker is plain, so the first of each marker is the one put in."""
    out, (p, s, m) = F.col(output), MARKERS
    size = len(p)
    first, second = F.when(F.col(form) == "psm", F.locate(s, out)).otherwise(F.locate(p, out)), F.locate(m, out)
    one, two, middle = F.substring(out, F.lit(size + 1), first - size - 1), F.substring(out, first + size, second - first - size), F.substring(out, second + size, F.length(out))
    return F.when(F.col(form) == "psm", F.concat(one, middle, two)).when(F.col(form) == "spm", F.concat(two, middle, one)).otherwise(out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


QUERIES = {"op12_fill_in_middle": op12}
SQL = {
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
     p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
}
