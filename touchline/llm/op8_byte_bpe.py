r"""Byte-level BPE by Spark's higher-order functions.

The pattern splits a text into pieces. A piece's bytes become the ids of single bytes, and a fold merges them: each step joins the leftmost pair of
lowest rank, until no pair has a rank. As a rank is the id of what the pair becomes, the rank map is kept on pairs of ids: ``merged[base[left] + right]``
is the id if ``owner`` holds ``left`` there, so that a look-up is plain arithmetic on arrays. The vocabulary and the most frequent of all distinct pieces are
folded once and become a table of bounded size; the pieces of the long tail, most of them seen once in all documents, are folded where they stand.
The tables are values of scalar subqueries, which the tasks hold as constants. Decoding joins the hex strings of the ids' pieces and makes them binary.

The fold is quadratic in a piece's length. Where the corpus has a piece of ``LONG`` characters or more (runs without a break), texts that hold such a one
take a side path, in which a heap merges these pieces in the same order.

Edge cases: a null text is empty and has no ids; invalid ids decode to nothing and null ones are left out; ids may be null or repeat, rows are independent; other columns pass
through but for those the operator adds; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, stored

HEAD = 1 << 18
"""Entries of the table of frequent pieces, besides the vocabulary."""
LONG = 512
_SLOTS = (1 << 19, 1 << 18, 1 << 15)
"""Places of the table: a piece that finds its place taken goes on to the next part."""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    r"""``\s`` and ``\S`` as Unicode white space."""
    return "(?U)" + pattern


def pair_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """``base``, ``owner`` and ``merged``: the id of a pair (left, right) is merged[base[left] + right] where owner is left there."""
    rights: dict[int, list[tuple[int, int]]] = {}
    for token, i in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rights.setdefault(left, []).append((right, i))
    ids = max(ranks.values(), default=0) + 1
    room = 1 << max(10, (4 * sum(map(len, rights.values()))).bit_length())
    base, owner, merged = np.zeros(ids, np.int32), np.full(room + ids, -1, np.int32), np.zeros(room + ids, np.int32)
    draw = np.random.default_rng(0)
    for left, found in sorted(rights.items(), key=lambda x: (-len(x[1]), x[0])):  # the longest rows first, while there is most room
        places, values = np.array(found, np.int64).T
        at = int(draw.integers(room))
        while (owner[at + places] >= 0).any():
            at = int(draw.integers(room))
        base[left], owner[at + places], merged[at + places] = at, left, values
    return {"base": base, "owner": owner, "merged": merged}


def _constants(spark: SparkSession, columns: dict, name: str) -> dict[str, DataFrame]:
    """A stored row of arrays, each as a one-column table."""
    row = stored(spark.createDataFrame(pa.table({k: pa.array([v]) for k, v in columns.items()})), name)
    return {k: row.select(k) for k in columns}


def _with(tables: dict[str, DataFrame], rows: DataFrame, result: str, value) -> DataFrame:
    """``rows`` with ``result = value(tables)``, each table a one-row, one-column constant.

    Subqueries can't stand inside a higher-order function. They are columns that the expression mentions once, so that the optimizer
    moves them into it; a second mention would make each row carry them.
    """
    held = rows.withColumns({f"_{k}": t.scalar() for k, t in tables.items()})
    bound = F.transform(F.array(F.struct(*[F.col(f"_{k}").alias(k) for k in tables])), value)
    return held.select(*[c for c in rows.columns if c != result], F.element_at(bound, 1).alias(result))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


_NONE = 1 << 62
"""Added to an element whose id's pair with the next one has no rank."""
_ID = 20
_AT = 12
"""Bits of an id and of a place; a piece has less than 4 * ``LONG`` bytes."""


def folded(piece: Column, t: Column) -> Column:
    """Ids of a piece: ranked merges over its bytes. Each element holds an id, above it its place and above that the id that it would become with the next one,
    so the least element is the next merge, the leftmost of equal ones; a merge changes two elements, takes one away and moves those behind by a place.
    ``array_position`` would find the place as well, but leaves its loop by an exception."""
    none = F.array().cast("array<long>")

    def number(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _ID) - 1)).cast("int")

    def label(i: Column, at: Column) -> Column:
        return F.shiftleft(at.cast("long"), _ID) + i

    def element(left: Column, right: Column, at: Column) -> Column:
        place = F.get(t["base"], left) + right
        return F.when(F.get(t["owner"], place) == left, F.shiftleft(F.get(t["merged"], place).cast("long"), _AT + _ID)).otherwise(F.lit(_NONE)) + label(left, at)

    def merge(parts: Column, _) -> Column:
        def at_lowest(low: Column) -> Column:
            new = F.shiftright(low, _AT + _ID).cast("int")

            def join(at: Column) -> Column:
                before = F.when(at > 0, F.array(element(number(F.get(parts, at - 1)), new, at - 1))).otherwise(none)
                here = F.when(at + 2 < F.size(parts), element(new, number(F.get(parts, at + 2)), at)).otherwise(F.lit(_NONE) + label(new, at))
                behind = F.transform(F.slice(parts, at + 3, F.size(parts)), lambda x: x - F.lit(1 << _ID))
                return F.flatten(F.array(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), before, F.array(here), behind))

            return F.when(low < _NONE, _let(F.shiftright(low, _ID).bitwiseAND(F.lit((1 << _AT) - 1)).cast("int"), join)).otherwise(parts)

        return _let(F.array_min(parts), at_lowest)

    def run(ids: Column) -> Column:
        start = F.transform(ids, lambda x, i: F.when(i + 1 < F.size(ids), element(x, F.get(ids, i + 1), i)).otherwise(F.lit(_NONE) + label(x, i)))
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, merge), number)

    def fold(bytes_: Column) -> Column:  # a character for each byte
        return _let(F.transform(F.sequence(F.lit(1), F.length(bytes_)), lambda i: F.get(t["bytes"], F.ascii(F.substring(bytes_, i, F.lit(1))))), run)

    return _let(F.decode(piece.cast("binary"), "ISO-8859-1"), fold)


def _place(hashed: Column, part: int) -> Column:
    """A piece's place in a part of the table, by some bits of its hash."""
    place = F.shiftright(hashed, 21 * part).bitwiseAND(F.lit(_SLOTS[part] - 1))
    return (place + sum(_SLOTS[:part])).cast("int") if part else place.cast("int")


def known_pieces(pairs: DataFrame) -> DataFrame:
    """One row of two arrays, ``keys`` and ``values``, in which a piece has one of three places. As many entries as ``pairs`` (key, value) has rows, which the caller
    bounds; the few pieces that find all their places taken are left out, and folded where they stand."""
    rest, placed = pairs, []
    for part in range(len(_SLOTS)):
        ranked = rest.select("key", "value", _place(F.xxhash64("key"), part).alias("slot"))
        ranked = stored(ranked.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("key"))), "placed")
        placed.append(ranked.where("r = 1").select("slot", "key", "value"))
        rest = ranked.where("r > 1")
    taken = placed[0].unionByName(placed[1]).unionByName(placed[2])
    slots = pairs.sparkSession.range(sum(_SLOTS)).select(F.col("id").cast("int").alias("slot")).join(taken, "slot", "left")
    rows = F.array_sort(F.collect_list(F.struct("slot", "key", "value")))
    return slots.agg(rows.alias("r")).select(F.transform("r", lambda r: r["key"]).alias("keys"), F.transform("r", lambda r: r["value"]).alias("values"))


def ids_of(pieces: Column, t: Column, other) -> Column:
    """The ids of all pieces, from the table or by ``other(piece)``."""

    def known(piece: Column, hashed: Column) -> Column:
        found = F
        for part in range(len(_SLOTS)):
            place = _place(hashed, part)
            found = found.when(F.get(t["keys"], place) == piece, F.get(t["values"], place))
        return found.otherwise(other(piece))

    return _let(pieces, lambda p: F.flatten(F.zip_with(p, F.transform(p, lambda x: F.xxhash64(x)), known)))


def merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece: a heap of pairs over a linked list of parts."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if (j := after[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, until = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != until:
            continue  # one of the two has changed meanwhile
        alive[j], end[i], after[i] = False, until, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _long_pieces(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.list_(pa.int32()))
        for batch in batches:
            found = [{p: merged_by_heap(p.encode(), ranks) for p in pieces if len(p) >= LONG} for pieces in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(x.items()) for x in found], kind)], names=[*batch.schema.names, "long"])

    return run


class Codec:
    """A rank file's vocabulary as tables of a session."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark, self.ranks, self.pattern = spark, ranks, java_pattern(pattern)
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.merges = _constants(spark, {"bytes": single, **pair_table(ranks)}, "merges")
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece.hex()
        coded = [{"number": i.to_bytes(4, "little").hex(), "piece": p} for i, p in enumerate(pieces)]
        self.pieces_of = _constants(spark, {"coded": coded}, "pieces")
        whole = []
        for piece, i in ranks.items():
            try:
                whole.append((piece.decode(), [i]))
            except UnicodeDecodeError:
                continue  # not a piece of any text
        self.vocabulary = stored(spark.createDataFrame(whole, "key string, value array<int>"), "vocabulary")

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def head(self, docs: DataFrame) -> tuple[dict[str, DataFrame], int]:
        """The ids of the vocabulary and of the most frequent pieces, and the length of the longest piece."""
        seen = Observation()
        each = docs.select(F.explode(self.pieces(F.col("text"))).alias("key")).observe(seen, F.max(F.length("key")).alias("longest"))
        counted = stored(each.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.length("key") < LONG)), "counted")
        # the least count of the frequent pieces, from how many pieces there are of each (rounded) count
        magnitude = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096)
        room, least = HEAD, 1 << 62
        for n, pieces in sorted(counted.groupBy(magnitude.alias("n")).count().collect(), reverse=True):
            if pieces > room:
                break
            room, least = room - pieces, n
        top = stored(counted.where(F.col("n") >= least).select("key"), "frequent")
        new = top.join(self.vocabulary, "key", "left_anti").repartition(64)
        ids = stored(_with(self.merges, new, "value", lambda t: folded(F.col("key"), t)).unionByName(self.vocabulary), "head")
        table = stored(known_pieces(ids), "head-table")
        return {k: table.select(k) for k in ("keys", "values")}, 0 if docs.isEmpty() else seen.get["longest"] or 0

    def encode(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` with ``ids``."""
        docs = docs.drop("ids", "pieces", "long")
        known, longest = self.head(docs)
        tables = known | self.merges
        pieces = self.pieces(F.col("text")).alias("pieces")

        def ids(t: Column) -> Column:
            return ids_of(F.col("pieces"), t, lambda p: folded(p, t))

        def ids_with_long(t: Column) -> Column:
            return ids_of(F.col("pieces"), t, lambda p: F.when(F.length(p) >= LONG, F.element_at("long", p)).otherwise(folded(p, t)))

        if longest < LONG:
            return _with(tables, docs.select("*", pieces), "ids", ids).select(*docs.columns, "ids")
        long_run = F.coalesce(F.rlike("text", F.lit(rf"(?U)\S{{{LONG - 1},}}|\s{{{LONG - 1},}}")), F.lit(False))
        usual, rare = docs.where(~long_run).select("*", pieces), docs.where(long_run).select("*", pieces)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rare.schema) + ", long map<string,array<int>>"
        rare = rare.mapInArrow(_long_pieces(self.ranks), schema)
        done = [_with(tables, part, "ids", value).select(*docs.columns, "ids") for part, value in ((usual, ids), (rare, ids_with_long))]
        return done[0].unionByName(done[1])

    def decode(self, rows: DataFrame, ids: str = "ids") -> DataFrame:
        """``rows`` with ``id_bytes`` (little-endian unsigned 32-bit integers) and ``decoded``, the bytes that the ids stand for."""
        rows = rows.drop("id_bytes", "decoded", "_coded")

        def number(i: Column) -> Column:  # of an id beyond the vocabulary
            digits = F.lpad(F.hex(i), 8, "0")
            return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])

        def both(t: Column) -> Column:
            known = F.transform(ids, lambda i: F.coalesce(F.get(t["coded"], i), F.when(i.isNotNull(), F.struct(number(i).alias("number"), F.lit("").alias("piece")))))
            return _let(known, lambda c: F.struct(F.unhex(F.array_join(c["number"], "")).alias("id_bytes"), F.unhex(F.array_join(c["piece"], "")).alias("decoded")))

        return _with(self.pieces_of, rows, "_coded", both).select(*rows.columns, "_coded.id_bytes", "_coded.decoded")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = Codec(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = codec.decode(codec.encode(documents(spark, sf_dir).select("doc_id", "text")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_byte_bpe": op8}
