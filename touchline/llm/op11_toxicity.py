"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata, and windows of context around each hit.

Learning (labelled rows only, at most ``FIT_ROWS`` of them, each distinct text once):

* Terms are whole words and stems (beginnings of words). A term marks a text in which at least ``MARKED`` of all words
  carry it. Texts that share their least shingle hashes share one vote, so that a group of near copies doesn't make all
  of its words terms. A term needs a likelihood ratio G2 beyond what the best of as many unrelated terms would reach by
  chance, and ``LIFT`` times the share of toxic texts that it marks among clean ones. The largest G2 comes first; terms
  that begin, or are begun by, one that was taken are left out.
* Inexact variants of a term that clean labelled texts use are kept as exceptions ("other words").
* Two discounts, for hits in quotation marks and for hits near a word that reports speech, from the labels of texts with
  such hits and a prior.
* A logistic regression on the weighted hits and their share of all words.

Scoring: a word's automaton (a bit for each of its positions, for 0, 1... errors) runs over the trie of the lexicon, for
all distinct words of a chunk at once; branches in which a word has no state left are cut. Terms of five letters and more
may be missed by one edit, of nine and more by two; stems only from seven letters on. A hit counts ``FUZZY`` per edit, times
the discounts of its context. Each text is scored inside one task; nothing of the corpus is shuffled.

Edge cases: a null text is empty; texts without words get the score of no hit; where labels hold one class only, the score
is its smoothed rate; null labels and ids teach nothing; ids labelled or stored more than once teach with each of their
texts and the mean label (a half counts as toxic); empty tables give no row; columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import Words, crc_fold, documents, mixed, range_hashes, stored, text_chunks

FIT_ROWS = 30_000
"""Labelled rows that the model is fitted on, at most."""
MARKED = 0.0025
"""Share of a text's words that a term must have to mark it."""
LEAST_VOTES, LIFT = 4, 5
TERMS, CANDIDATES = 128, 4096
"""Terms of the lexicon, and terms considered for it, those of largest G2 first."""
VOTE_HASHES, VOTE_WORDS, VOTE = 4, 3, 1 << 20
"""Least hashes of a text that are compared, words of a shingle, and the integer that stands for one vote (sums of integers don't depend on their order)."""
SHORTEST, STEM = 4, (3, 9)
"""Letters of a whole word at least; of a stem from and to."""
FUZZY = 0.5
WINDOW = 8
"""Words on either side of a hit that are its context."""
OUTPUTS = ["score", "predicted", "n_hits", "n_fuzzy", "n_quoted"]
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says saying wrote writes called quoted quote word words term phrase sagte sagt schrieb nannte wort zitat dit disait mot terme citation dijo dice palabra cita".split())
"""Marks around a quotation, and words that announce one. A parameter of the method, not learned."""
KNOWN_WORDS = 400_000
"""Distinct words that a task remembers."""


def errors_of(term: str, stem: bool) -> int:
    """Edits by which a term may be missed."""
    n = len(term)
    return 0 if n < (7 if stem else 5) else 1 if n < 9 else 2


class Trie:
    """The lexicon; ``match`` runs the automata of many words over it."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.most = [errors_of(t, s) for t, s in terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, (term, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
        self.errors = [0] * len(self.children)  # of the terms at or below a node
        for node in reversed(range(len(self.children))):
            below = [self.errors[c] for c in self.children[node].values()]
            self.errors[node] = max([*below, *(self.most[i] for i in self.ends[node])], default=0)
        self.reach = max((len(t) for t, _ in terms), default=0) + self.errors[0] + 1

    def match(self, words: list[str]) -> list[tuple[int, int] | None]:
        """(term, errors) of the term that fits a word with the fewest errors, longer terms first among equals."""
        best = np.full(len(words), 1 << 30, np.int64)  # errors, then the term's rank
        rank = {i: r for r, i in enumerate(sorted(range(len(self.terms)), key=lambda i: (-len(self.terms[i][0]), self.terms[i])))}
        size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), self.reach)
        points = np.frombuffer("".join(w[: self.reach].ljust(self.reach, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), self.reach)
        bits = np.uint64(1) << np.arange(self.reach, dtype=np.uint64)
        letters = {c for child in self.children for c in child}
        found = {c: ((points == ord(c)) @ bits).astype(np.uint64) for c in letters}
        last, one = np.uint64(1) << size.astype(np.uint64), np.uint64(1)
        inside = (last << one) - one
        k = self.errors[0]
        # a state is a place in the word, reached with e errors or fewer
        start = [np.minimum((one << np.uint64(e + 1)) - one, inside) for e in range(k + 1)]
        stack = [(0, np.arange(len(words)), start)]
        while stack:
            node, mine, states = stack.pop()
            for i in self.ends[node]:
                wanted = np.uint64(0xFFFFFFFFFFFFFFFF) if self.terms[i][1] else last[mine]
                for e in range(self.most[i] + 1):
                    fits = (states[e] & wanted) != 0
                    best[mine[fits]] = np.minimum(best[mine[fits]], e * len(rank) + rank[i])
            for c, child in self.children[node].items():
                moved: list[np.ndarray] = []
                for e in range(self.errors[child] + 1):
                    to = (states[e] & found[c][mine]) << one
                    if e:
                        to |= states[e - 1] | (states[e - 1] << one) | (moved[e - 1] << one)
                    moved.append(to & inside[mine])
                alive = moved[-1] != 0
                if alive.any():
                    stack.append((child, mine[alive], [m[alive] for m in moved]))
        by_rank = {r: i for i, r in rank.items()}
        return [None if b == 1 << 30 else (by_rank[b % len(rank)], b // len(rank)) for b in best.tolist()]


@dataclass
class Model:
    """What was learned; as small as its lexicon and exceptions."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    quoted: float = 0.25
    reported: float = 0.5
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


class Finder:
    """The hits in texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.terms)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def learn(self, words: set[str]) -> None:
        if not self.model.terms:
            return
        if len(self.seen) > KNOWN_WORDS:
            self.seen, self.hits = set(), {}
        new = list(words - self.seen)
        self.seen.update(new)
        for w, hit in zip(new, self.trie.match(new) if new else (), strict=True):
            if hit and not (hit[1] and variant(w, self.model.terms[hit[0]]) in self.model.exceptions):
                self.hits[w] = hit

    def find(self, text: str, words: list[str]) -> list[tuple[str, int, bool, bool]]:
        """(word, errors, quoted, reported) of each hit."""
        at = [i for i, w in enumerate(words) if w in self.hits]
        if not at:
            return []
        inside = quoted_words(text, at) if any(q in text for q in QUOTES) else set()
        near = lambda i: any(w in REPORTING for w in words[max(0, i - WINDOW) : i])
        return [(words[i], self.hits[words[i]][1], i in inside, near(i)) for i in at]


def variant(word: str, term: tuple[str, bool]) -> str:
    """What stands in a word for the term."""
    return word[: len(term[0])] if term[1] else word


def quoted_words(text: str, at: list[int]) -> set[int]:
    """Those of the words ``at`` that have a quotation mark within the window before and after them, on their own line."""
    wanted, found, spans = set(at), set(), [m.span() for m in WORD.finditer(text)]
    for i in wanted:
        before, after = text[spans[max(0, i - WINDOW)][0] : spans[i][0]], text[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
        opened, closed = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
        # a plain mark both opens and closes: an odd number of them before the word leaves one open
        left = sum(opened.count(q) for q in QUOTES)
        if left % 2 and any(q in closed for q in QUOTES):
            found.add(i)
    return found


def _texts(batch: pa.RecordBatch, column: str) -> tuple[list[str], list[list[str]]]:
    texts = [(t or "").lower() for t in batch.column(column).to_pylist()]
    return texts, [WORD.findall(t) for t in texts]


def _slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def marks(words: list[str]) -> Iterator[tuple[str, bool]]:
    """The terms, whole words and stems, that mark a text."""
    counts: Counter[tuple[str, bool]] = Counter()
    for w, n in Counter(words).items():
        if len(w) >= SHORTEST:
            counts[w, False] += n
        for k in range(STEM[0], min(STEM[1], len(w)) + 1):
            counts[w[:k], True] += n
    least = MARKED * len(words)
    return (t for t, n in counts.items() if n >= least)


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[dict, dict] = ({}, {})
    for batch in _slices(batches, "text"):
        for words, toxic, vote in zip(_texts(batch, "text")[1], batch.column("toxic").to_pylist(), batch.column("vote").to_pylist(), strict=True):
            mine = seen[toxic]
            for t in marks(words):
                mine[t] = mine.get(t, 0) + vote
    terms = list(seen[0] | seen[1])
    for lo in range(0, len(terms), 50_000):
        some = terms[lo : lo + 50_000]
        yield pa.RecordBatch.from_pydict({"term": [t for t, _ in some], "stem": [s for _, s in some], "pos": pa.array([seen[1].get(t, 0) for t in some], pa.int64()), "neg": pa.array([seen[0].get(t, 0) for t in some], pa.int64())})


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the least of ``VOTE_HASHES`` hashes over its shingles; the same for all texts with fewer words."""
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            words = Words(data, offsets, fold=True)
            starts = np.arange(max(len(words.starts) - VOTE_WORDS + 1, 0))
            doc = words.doc_of_word()
            starts = starts[doc[starts] == doc[starts + VOTE_WORDS - 1]] if len(starts) else starts
            shingles = range_hashes(words.hashes(), starts, starts + VOTE_WORDS)
            out = []
            for i in range(VOTE_HASHES):
                least = np.full(hi - lo, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, doc[starts], mixed(shingles + np.uint64(i + 1)))
                out.append(least.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("h").slice(lo, hi - lo), *map(pa.array, out)], names=["h", *(f"m{i}" for i in range(VOTE_HASHES))])


def lexicon(candidates: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The first ``TERMS`` candidates of which none begins another."""
    chosen: list[tuple[str, bool]] = []
    for term, stem in candidates:
        if len(chosen) < TERMS and not any(term.startswith(t) or t.startswith(term) for t, _ in chosen):
            chosen.append((term, stem))
    return chosen


def features(weight: float, n_words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / n_words) if n_words else 0.0


def hit_weight(model: Model, hits: list[tuple[str, int, bool, bool]]) -> float:
    return sum(FUZZY**errors * (model.quoted if quoted else 1.0) * (model.reported if reported else 1.0) for _, errors, quoted, reported in hits)


def _discount(toxic: float, clean: float, plain_toxic: float, plain_clean: float, prior: float, strength: float = 10.0) -> float:
    """The share of toxic among texts with such hits, relative to that among texts with plain ones."""
    plain = (plain_toxic + 1) / (plain_toxic + plain_clean + 1)
    return min(1.0, (toxic + prior * strength) / (toxic + clean + strength) / plain)


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression with an intercept by Newton's method."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, vote): at most ``bound`` labelled ids, chosen by a hash of the id, each distinct text once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg((F.col("toxic") > 0).cast("double")).alias("toxic"))
    n = known.count()
    share = 1.0 if n <= bound else bound / n
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # at most ``bound`` rows of two numbers
    once = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.first("text").alias("text"), F.avg("toxic").alias("toxic"))
    once = stored(once.select("h", "text", (F.col("toxic") >= 0.5).cast("int").alias("toxic")), "toxicity-texts")
    names = [f"m{i}" for i in range(VOTE_HASHES)]
    hashed = once.select("h", "text").mapInArrow(_least_hashes, "h string, " + ", ".join(f"{m} long" for m in names))
    each = stored(hashed.select("h", F.posexplode(F.array(*names)).alias("i", "m")), "toxicity-hashes")
    alike = each.groupBy("i", "m").agg(F.count("*").alias("n"))
    votes = each.join(alike, ["i", "m"]).groupBy("h").agg(F.greatest(F.lit(1), F.round(VOTE / F.max("n"))).cast("long").alias("vote"))
    return stored(once.join(votes, "h").select("text", "toxic", "vote"), "toxicity-training")


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) know."""
    rows = training_rows(docs, labels, bound)
    sizes = {r.toxic: (r.n, r.votes / VOTE) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("vote").alias("votes")).collect()}
    if len(sizes) < 2:
        all_pos, all_neg = (sizes.get(k, (0, 0))[0] for k in (1, 0))
        rate = (all_pos + 0.5) / (all_pos + all_neg + 1)
        return Model(weights=(math.log(rate / (1 - rate)), 0.0, 0.0))
    all_pos, all_neg = sizes[1][1], sizes[0][1]
    counted = rows.mapInArrow(_mark_counts, "term string, stem boolean, pos long, neg long").groupBy("term", "stem").agg((F.sum("pos") / VOTE).alias("pos"), (F.sum("neg") / VOTE).alias("neg"))
    counted = stored(counted, "toxicity-marks")
    least = 2 * math.log(max(counted.count(), 2))
    log = lambda k, margin, whole: F.when(k > 0, k * F.log(k * (all_pos + all_neg) / (margin * whole))).otherwise(0.0)
    pos, neg, marked = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    ratio = 2 * (log(pos, marked, all_pos) + log(neg, marked, all_neg) + log(all_pos - pos, all_pos + all_neg - marked, all_pos) + log(all_neg - neg, all_pos + all_neg - marked, all_neg))
    speaking = counted.where((pos >= LEAST_VOTES) & (pos * all_neg >= LIFT * neg * all_pos)).withColumn("g2", F.round(ratio, 6)).where(F.col("g2") >= least)
    model = Model(terms=lexicon([(r.term, r.stem) for r in speaking.orderBy(F.desc("g2"), "stem", F.desc(F.length("term")), "term").limit(CANDIDATES).collect()]))
    model.exceptions = _exceptions(rows, model)
    return _with_weights(rows, model)


def _exceptions(rows: DataFrame, model: Model) -> frozenset[str]:
    """Inexact variants that speak for clean texts rather than for toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = Finder(model), (Counter(), Counter())
        for batch in _slices(batches, "text"):
            listed = _texts(batch, "text")[1]
            finder.learn({w for words in listed for w in words})
            for words, toxic in zip(listed, batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({variant(w, model.terms[finder.hits[w][0]]) for w in set(words) if w in finder.hits and finder.hits[w][1]})
        both = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict({"word": pa.array(both, pa.string()), "pos": pa.array([seen[1][w] for w in both], pa.int64()), "neg": pa.array([seen[0][w] for w in both], pa.int64())})

    sums = rows.mapInArrow(run, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return frozenset(r.word for r in sums.where((F.col("neg") > 0) & (F.col("neg") * 2 >= F.col("pos"))).select("word").collect())


def _with_weights(rows: DataFrame, model: Model) -> Model:
    """The model with discounts of contexts and the regression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in _slices(batches, "text"):
            texts, listed = _texts(batch, "text")
            finder.learn({w for words in listed for w in words})
            out: list[list] = [[], [], [], [], []]
            for text, words, toxic in zip(texts, listed, batch.column("toxic").to_pylist(), strict=True):
                weights = [0.0, 0.0, 0.0, 0.0]
                for _, errors, quoted, reported in finder.find(text, words):
                    weights[2 * quoted + reported] += FUZZY**errors
                for column, value in zip(out, (toxic, len(words), weights, bool(weights[2] + weights[3]), bool(weights[1] + weights[3])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3]), pa.array(out[4])], names=["toxic", "n", "w", "quoted", "reported"])

    # five numbers for each of at most ``bound`` rows
    found = rows.mapInArrow(run, "toxic int, n long, w array<double>, quoted boolean, reported boolean").collect()
    count = lambda toxic, which: sum(r.toxic == toxic and which(r) for r in found)
    plain = [count(t, lambda r: r.w[0] > 0) for t in (1, 0)]
    only = lambda i: [count(t, lambda r: r.w[i] > 0 and r.w[0] == 0) for t in (1, 0)]
    model.quoted, model.reported = _discount(*only(2), *plain, 0.25), _discount(*only(1), *plain, 0.5)
    factors = (1.0, model.reported, model.quoted, model.quoted * model.reported)
    x = np.array([features(sum(a * b for a, b in zip(r.w, factors, strict=True)), r.n) for r in sorted(found, key=lambda r: (r.toxic, r.n, r.w))])
    y = np.array(sorted(r.toxic for r in found), float)
    model.weights = _fitted(x, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score, predicted, and the numbers of hits, of inexact ones and of quoted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, w = Finder(model), model.weights
        for batch in _slices(batches, text_col):
            texts, listed = _texts(batch, text_col)
            finder.learn({x for words in listed for x in words})
            out: list[list] = [[] for _ in OUTPUTS]
            for text, words in zip(texts, listed, strict=True):
                hits = finder.find(text, words)
                a, b = features(hit_weight(model, hits), len(words))
                p = round(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b)))), 9)
                for column, value in zip(out, (p, int(p >= threshold), len(hits), sum(h[1] > 0 for h in hits), sum(h[2] for h in hits)), strict=True):
                    column.append(value)
            made = [pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *OUTPUTS])

    rows = docs.select(*[c for c in docs.columns if c not in OUTPUTS or c == text_col])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int, n_hits long, n_fuzzy long, n_quoted long")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 3) != 1)
    model = fit(docs.where(~F.col("held_out")), labels)
    return score(docs, model).select("doc_id", "held_out", "score", "predicted", "n_hits", "n_fuzzy", "n_quoted")


QUERIES = {"op11_toxicity": op11}
