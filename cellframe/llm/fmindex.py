"""An FM-index over segments of words, with its last column in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks of symbols below 2^bits, as one bit vector with a rank directory for every bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, np.cumsum(ones) - ones, self.n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start, end = np.zeros_like(at), at
        for depth, (words, ranks, zeros) in enumerate(self.levels):
            ones = [ranks[p >> 6] + np.bitwise_count(words[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))) for p in (start, end)]
            set_ = (symbol >> (self.bits - 1 - depth) & 1).astype(bool)
            start, end = np.where(set_, zeros + ones[0], start - ones[0]), np.where(set_, zeros + ones[1], end - ones[1])
        return end - start


class FMIndex:
    """Backward search for patterns of up to 16 words.

    The text is the segments' words as ranks from 1, each segment followed by 0. Suffixes are sorted by their first 16
    words, which is all that a search for patterns of that length depends on: the rows before an interval are those
    with a smaller beginning, and how many of them follow a symbol places the next interval.
    """

    LONGEST = 16

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        """``words``: a 64-bit value of each word, segment after segment; ``counts``: the words of each segment."""
        self.alphabet, code = np.unique(words, return_inverse=True)
        ends = np.cumsum(counts + 1)
        self.text = np.zeros(int(ends[-1]), np.int64)
        inner = np.ones(len(self.text), bool)
        inner[ends - 1] = False
        self.text[inner] = code + 1
        self.starts = ends - counts - 1
        n, rank = len(self.text), self.text
        for k in (1, 2, 4, 8):
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:]
            key = rank * (int(rank.max()) + 1) + after
            if k < 8:
                rank = np.unique(key, return_inverse=True)[1] + 1
            else:
                self.order = np.argsort(key, kind="stable")
        self.first = np.searchsorted(np.sort(self.text), np.arange(len(self.alphabet) + 2))
        self.wavelet = Wavelet(self.text[self.order - 1], max(1, int(len(self.alphabet)).bit_length()))

    def search(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the index's own text, up to ``length``, for the patterns that end at ``ends``.

        (words matched elsewhere too, interval start, interval end): a search goes on to the left while its interval
        holds more than the pattern's own row.
        """
        symbol = self.text[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        matched = (high - low > 1).astype(np.int64)
        live = np.flatnonzero(matched)
        for step in range(1, length):
            if not len(live):
                break
            symbol = self.text[ends[live] - step]
            n = len(live)
            rank = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.first[symbol] + rank[:n], self.first[symbol] + rank[n:]
            live = live[high[live] - low[live] > 1]
            matched[live] += 1
        return matched, low, high

    def least(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of ``values`` (of each place in the text) over intervals that are equal or apart."""
        own, back = np.unique(low, return_inverse=True)
        end = np.zeros(len(own), np.int64)
        end[back] = high
        rows = np.append(values[self.order], np.iinfo(np.int64).max)
        return np.minimum.reduceat(rows, np.stack([own, end], 1).ravel())[::2][back] if len(own) else np.empty(0, np.int64)
