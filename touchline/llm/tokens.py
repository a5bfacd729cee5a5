"""Encoding of whole texts with a tokenizers file inside tasks: distinct parts are encoded once, by a bounded cache."""

from __future__ import annotations

import os

import numpy as np

from touchline.llm.common import byte_hashes

CACHE = 600_000
RECENT = 100_000
POOL = 2_000_000
"""Parts and ids that a worker remembers at most (some 45 MB); beyond that it starts anew."""


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _letters() -> np.ndarray:
    byte = np.arange(256)
    return ((byte | 32) >= 97) & ((byte | 32) <= 122)


_LETTER = _letters()
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing an id: the pattern of a byte-level vocabulary never makes a piece across these places.

    Before a run of white space, after a newline that stands alone, and between an ASCII letter and an ASCII mark but the apostrophe.
    Only spaces and newlines count as white space; texts with other kinds are not cut (see ``unusual``).
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    white = np.ones(n + 2, bool)  # white[i + 1] belongs to byte i
    white[1:-1] = (data == 32) | (data == 10)
    before, here, after = white[:-2].copy(), white[1:-1], white[2:].copy()
    inner = edge[:n]
    before[inner] = False  # a text's first byte has nothing before it
    after[edge[1:]] = False
    cut = inner | (here & ~before)
    alone = (data == 10) & ~before & ~after
    cut[1:] |= alone[:-1]
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return np.flatnonzero(cut)


def unusual(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space other than space and newline, or with what may begin an added token."""
    a = data
    b, c = np.append(a[1:], 0)[: len(a)], np.append(a[2:], [0, 0])[: len(a)]
    odd = ((a < 32) & (a != 10)) | ((a == 60) & (b == 124)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    odd |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
    odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)


def ends_of_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each part and its last eight, as numbers; shorter parts are filled up with zeros."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 9, 8), (1, 1))
    fill = np.uint64(8) * np.maximum(8 - (ends - starts), 0).astype(np.uint64)
    head = eight[starts + 8].reshape(-1).view("<u8")
    tail = eight[ends].reshape(-1).view("<u8")
    return (head << fill) >> fill, (tail >> fill) << fill


class _Level:
    """Sorted keys of parts with what tells parts apart, and the place and number of their ids."""

    def __init__(self):
        self.columns = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *columns: np.ndarray) -> None:
        merged = [np.concatenate([a, b]) for a, b in zip(self.columns, columns, strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.columns = [m[order] for m in merged]

    def find(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        keys, heads, tails, places, sizes = self.columns
        if len(keys):
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = np.flatnonzero((keys[where] == key) & (heads[where] == head) & (tails[where] == tail))
            at[same], size[same] = places[where[same]], sizes[where[same]]


class Encoder:
    """Ids of whole texts. A text is cut into parts at safe places; each different part is encoded once.

    A part is looked up by a 64-bit hash, and its first and last eight bytes must be the same; in the pieces of usual texts that is all of it.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.characters = str.maketrans({chr(b): c for b, c in _byte_characters().items()})
        self.space = " ".translate(self.characters)
        self.forget()

    def forget(self) -> None:
        self.base, self.recent = _Level(), _Level()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, raw: bytes) -> list[int]:
        """Letters with or without a space before them are one piece, which the model takes as it is."""
        word = raw[1:] if raw[:1] == b" " else raw
        lead = self.space if len(word) < len(raw) else ""
        if word.isalpha():  # ASCII letters
            return [t.id for t in self.model.tokenize(lead + word.decode())]
        text = word.decode()
        if text.isalpha():
            return [t.id for t in self.model.tokenize(lead + word.decode("latin-1").translate(self.characters))]
        return self.plain(raw.decode())

    def _store(self, parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.array([i for p in parts for i in p], np.uint32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return at, size

    def _usual(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = safe_cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        h = byte_hashes(data, starts, ends, 11)
        heads, tails = ends_of_parts(data, starts, ends)
        key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        head, tail = heads[first], tails[first]
        if (head[inverse] != heads).any() or (tail[inverse] != tails).any():  # different parts of one hash
            lists = [self.plain(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        if len(self.base) > CACHE or self.used > POOL:
            self.forget()
        at, size = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        self.base.find(key, head, tail, at, size)
        self.recent.find(key, head, tail, at, size)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            raw = data.tobytes()
            at[missing], size[missing] = self._store([self._part(raw[a:b]) for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
            self.recent.add(key[missing], head[missing], tail[missing], at[missing], size[missing])
            if len(self.recent) > RECENT:
                self.base.add(*self.recent.columns)
                self.recent = _Level()
        n = size[inverse]
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(at[inverse] - (upto - n), n) + np.arange(upto[-1])]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts and how many each has."""
        odd = unusual(data, offsets)
        if not len(odd):
            return self._usual(data, offsets)
        ids, counts, begin = [], [], 0
        for i in [*odd.tolist(), len(offsets) - 1]:
            a, b = offsets[begin], offsets[i]
            x, n = self._usual(data[a:b], offsets[begin : i + 1] - a)
            ids.append(x)
            counts.append(n)
            if i < len(offsets) - 1:
                x = np.array(self.plain(data[b : offsets[i + 1]].tobytes().decode()), np.uint32)
                ids.append(x)
                counts.append(np.array([len(x)]))
            begin = i + 1
        return np.concatenate(ids), np.concatenate(counts)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for: in a byte-level vocabulary a character stands for a byte, but for added tokens."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = set(self.tokenizer.get_added_tokens_decoder())
        lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            lengths[i] = len(token.encode()) if i in added else len(token)
        return lengths


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """One encoder for a worker process and definition."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def definition_at(path: str) -> str:
    """The tokenizer's JSON, read on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def last_id(definition: str) -> int:
    """The largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values(), default=0)
