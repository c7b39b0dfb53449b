"""Monotone sequences in Elias-Fano form, and a two-level n-gram trie made of them, in one mappable file."""

from __future__ import annotations

import numpy as np

U1, U6, U63 = np.uint64(1), np.uint64(6), np.uint64(63)
#: Counts up to EXACT keep their value, larger ones one of the steps of a geometric scale.
EXACT, RATIO = 4096, 1.0005


class EliasFano:
    """Increasing values: the low bits packed, the high bits as unary gaps with directories of ones and zeros."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["head"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + (top >> width) + 2
        bit = np.zeros(-(-size // 64) * 64, bool)
        bit[high + np.arange(n)] = True
        words = np.packbits(bit, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        low = np.zeros(-(-n * width // 64) + 2, np.uint64)
        if width:
            part = values & ((U1 << np.uint64(width)) - U1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> U6).astype(np.int64), at & U63
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        zeros = 64 - ones
        return {"head": np.array([n, width], np.int64), "low": low, "high": words, "ones": np.cumsum(ones) - ones, "zeros": np.cumsum(zeros) - zeros}

    @staticmethod
    def _select(words: np.ndarray, ranks: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places of the k-th set bits, by the directory and then by halves of a word."""
        word = np.searchsorted(ranks, k, "right") - 1
        left, bits, at = k - ranks[word], words(word), np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits >> at & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left = left - np.where(up, n, 0)
            at = at + np.where(up, np.uint64(half), np.uint64(0))
        return word * 64 + at.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> U6).astype(np.int64), at & U63
        spill = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, U1)), np.uint64(0))
        return (self.low[word] >> shift | spill) & ((U1 << np.uint64(self.width)) - U1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(lambda w: self.high[w], self.ones, i) - i
        return high.astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def successor(self, x: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | None = None) -> np.ndarray:
        """Where the first value of at least x lies among the values from ``low`` to before ``high``; else ``high``."""
        high = np.full(len(x), self.n) if high is None else high
        top = (x >> np.uint64(self.width)).astype(np.int64)
        inside = top < int(self.zeros[-1] + np.bitwise_count(~self.high[-1:])[0]) if len(self.high) else np.zeros(len(x), bool)
        a, b = np.full(len(x), self.n), np.full(len(x), self.n)
        k = top[inside]
        unset = lambda w: ~self.high[w]
        first = np.zeros(len(k), np.int64)
        some = k > 0
        first[some] = self._select(unset, self.zeros, k[some] - 1) - (k[some] - 1)
        a[inside], b[inside] = first, self._select(unset, self.zeros, k) - k
        a, b = np.clip(a, low, high), np.clip(b, low, high)
        want = x & ((U1 << np.uint64(self.width)) - U1)
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) // 2
            less = self._low(mid) < want[live]
            a[live], b[live] = np.where(less, mid + 1, a[live]), np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        return a

    def find(self, x: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | None = None) -> np.ndarray:
        """Where each value lies, -1 where it is absent."""
        at = self.successor(x, low, high)
        end = np.full(len(x), self.n) if high is None else high
        found = np.flatnonzero(at < end)
        out = np.full(len(x), -1)
        hit = found[self.get(at[found]) == x[found]]
        out[hit] = at[hit]
        return out


def quantise(count: np.ndarray) -> np.ndarray:
    """16-bit codes of counts; 0 stays 0."""
    count = np.asarray(count, np.float64)
    over = EXACT + np.round(np.log(np.maximum(count, EXACT) / EXACT) / np.log(RATIO))
    return np.where(count <= EXACT, count, np.minimum(over, 65535)).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.float64)
    return np.where(code <= EXACT, code, EXACT * RATIO ** (code - EXACT))


class Trie:
    """Contexts (64-bit keys), each with the range of its successors (SUFFIX-bit keys) and their quantised counts.

    All levels lie in one file: a table of array sizes, then the arrays. ``open`` maps it, so a search touches only
    the pages it needs.
    """

    SUFFIX = 40
    LEVELS = ("contexts", "pointers", "successors")
    KINDS = {"head": np.int64, "low": np.uint64, "high": np.uint64, "ones": np.int64, "zeros": np.int64}

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, counts: np.ndarray, path: str) -> None:
        """``contexts`` ascending and distinct; ``successors`` ascending within each context, which has ``sizes``."""
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
        levels = {
            "contexts": EliasFano.arrays(contexts),
            "pointers": EliasFano.arrays(np.concatenate([[0], np.cumsum(sizes)])),
            "successors": EliasFano.arrays(owner << np.uint64(Trie.SUFFIX) | successors.astype(np.uint64)),
        }
        flat = [levels[k][a] for k in Trie.LEVELS for a in Trie.KINDS] + [np.pad(quantise(counts), (0, -len(counts) % 4))]
        with open(path, "wb") as file:
            file.write(np.array([len(a) for a in flat], np.int64).tobytes())
            for a in flat:
                file.write(np.ascontiguousarray(a).tobytes())

    @staticmethod
    def open(path: str) -> Trie:
        data = np.memmap(path, np.uint8, "r")
        kinds = [t for _ in Trie.LEVELS for t in Trie.KINDS.values()] + [np.uint16]
        sizes, at, arrays = data[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
        for n, kind in zip(sizes.tolist(), kinds):
            step = n * np.dtype(kind).itemsize
            arrays.append(data[at : at + step].view(kind))
            at += step
        trie = Trie()
        for i, name in enumerate(Trie.LEVELS):
            setattr(trie, name, EliasFano(dict(zip(Trie.KINDS, arrays[5 * i : 5 * i + 5]))))
        trie.codes = arrays[-1]
        return trie

    def counts(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of successors: of each context the next ``sizes`` ones; 0 where a context or successor is absent."""
        at = self.contexts.find(contexts)
        known = at >= 0
        low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        low[known] = self.pointers.get(at[known])
        high[known] = self.pointers.get(at[known] + 1)
        x = np.repeat(np.maximum(at, 0).astype(np.uint64) << np.uint64(Trie.SUFFIX), sizes) | successors.astype(np.uint64)
        place = self.successors.find(x, np.repeat(low, sizes), np.repeat(high, sizes))
        out = np.zeros(len(x), np.uint16)
        hit = place >= 0
        out[hit] = self.codes[place[hit]]
        return out
