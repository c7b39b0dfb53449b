"""Matches of the byte-level BPE pattern over many texts at once, and a table of the pieces already encoded.

The pattern splits a text into contractions, runs of letters, of digits and of other signs, each with a space before
it, and white space. Here the splits are found from the classes of the code points with array operations; a text too
long for one pass is split in halves, and halves are joined by splitting a growing window around the seam again
until the matches beyond it are the same as before.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

from cellframe.llm.text import mix, ragged, span_hashes

#: The code points with the White_Space property, and the contractions of the pattern.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, LETTER, DIGIT, SPACE = range(4)
#: Code points split in one pass. A match looks at most LOOK code points past its end.
PASS = 1 << 20
LOOK = 4


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start, in texts that lie one after the other in ``points``."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 3, bool)  # of a text; and beyond the end
    first[text_starts[text_starts < n]] = True
    first[n:] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True  # the last white space before a run stands alone or goes with it
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero((points == ord("'")) & start)
    if len(quote):
        ahead = np.concatenate([points, np.zeros(3, np.uint32)])
        for short in CONTRACTIONS:
            hit = quote
            for k, c in enumerate(short, 1):
                hit = hit[(ahead[hit + k] == ord(c)) & ~first[hit + k]]
            start[hit + 1] = False
            beyond = hit + 1 + len(short)
            start[beyond[beyond < n]] = True
    return np.flatnonzero(start)


def split(text: str, size: int = PASS) -> np.ndarray:
    """The starts of one text of any length, by joining those of its halves."""
    if len(text) <= size:
        return piece_starts(code_points(text), np.zeros(1, np.int64))
    mid = len(text) // 2
    return join(text, mid, split(text[:mid], size), split(text[mid:], size) + mid)


def join(text: str, mid: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Starts of a text from those of its two parts.

    A match depends on what follows its own start alone. So the left part's starts hold but for those near the seam,
    and where a window that begins at such a start meets a start of the right part, all that follows is the same.
    """
    sure = left[left + LOOK < mid]
    at = int(sure[-1]) if len(sure) else 0
    sure, reach = sure[sure < at], 64
    while True:
        end = min(len(text), mid + reach)
        own = piece_starts(code_points(text[at:end]), np.zeros(1, np.int64)) + at
        if end == len(text):
            return np.concatenate([sure, own])
        met = np.intersect1d(own[own + LOOK < end], right, assume_unique=True)
        if len(met):
            return np.concatenate([sure, own[own < met[0]], right[right >= met[0]]])
        reach *= 4


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """Integers by 64-bit key: an open hash table that looks up whole arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The first place of each key; keys that are close to each other lie apart."""
        return (keys * GOLDEN >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        at = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.values[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of several to one slot, the last stays
            rest = np.flatnonzero((self.keys[at] != keys) | (self.values[at] != values))
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, -1 where a key is absent."""
        at = self.slot(keys)
        out = self.values[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out


class PieceIds:
    """Token ids of texts; every different piece is encoded once while the table has room for it."""

    def __init__(self, encode_many: Callable[[list[str]], Sequence[Sequence[int]]], bits: int = 20):
        self.encode_many, self.bits = encode_many, bits
        self.clear()

    def clear(self) -> None:
        self.slots, self.n = Slots(self.bits), 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first = np.zeros((1 << self.bits - 1) + 1, np.int64)

    def learn(self, keys: np.ndarray, strings: list[str]) -> None:
        ids = self.encode_many(strings)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.used + int(sizes.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * need - self.used, np.uint32)])
        self.flat[self.used : need] = np.fromiter((i for x in ids for i in x), np.uint32, need - self.used)
        self.first[self.n + 1 : self.n + 1 + len(ids)] = self.used + np.cumsum(sizes)
        self.slots.add(keys, np.arange(self.n, self.n + len(ids), dtype=np.int32))
        self.n, self.used = self.n + len(ids), need

    def of_spans(self, joined: str, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of ``joined``, and how many each piece has."""
        ends = np.append(starts[1:], len(points))
        keys = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        found = self.slots.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            if self.n + len(new) > len(self.first) - 1:
                self.clear()
                new, where = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            room = len(self.first) - 1
            assert len(new) <= room, "a pass holds fewer pieces than the table"
            self.learn(new, [joined[starts[i] : ends[i]] for i in missing[where].tolist()])
            found = self.slots.get(keys)
        counts = self.first[found + 1] - self.first[found]
        return self.flat[ragged(self.first[found], counts)], counts

    def of_text(self, text: str) -> np.ndarray:
        """The ids of one text of any length."""
        starts, out, done = split(text), [], 0
        while done < len(starts):
            upto = max(done + 1, int(np.searchsorted(starts, starts[done] + PASS // 2)))
            begin, end = int(starts[done]), int(starts[upto]) if upto < len(starts) else len(text)
            part = text[begin:end]
            out.append(self.of_spans(part, code_points(part), starts[done:upto] - begin)[0])
            done = upto
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def of_texts(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        pending: list[str] = []
        size = 0
        for text in texts:
            if len(text) > PASS // 4:
                yield from self._together(pending)
                pending, size = [], 0
                yield self.of_text(text)
                continue
            if size + len(text) > PASS // 2:
                yield from self._together(pending)
                pending, size = [], 0
            pending.append(text)
            size += len(text)
        yield from self._together(pending)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        joined = "".join(texts)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        points = code_points(joined)
        starts = piece_starts(points, edges[:-1])
        ids, counts = self.of_spans(joined, points, starts)
        total = np.concatenate([[0], np.cumsum(counts)])
        cuts = total[np.searchsorted(starts, edges)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b]
