"""Words of many texts at once, as arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. ``Words`` holds the words of a batch of texts: where each
begins and ends in the joined bytes, a 64-bit hash of each and how many every text has. Two different words share a
hash with a probability of about 2^-64 a pair, which the operators accept where they say so.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True

#: An odd base whose neighbours hold few factors of two, so that powers of it don't cancel modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 5
_rng = np.random.default_rng(20)
#: A random 64-bit value of each byte.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 12
#: Bytes whose words are hashed in one pass.
BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP = _powers(BASE, _STEP)
_DOWN = _powers(pow(BASE, -1, 1 << 64), _STEP)
_LEAP_UP, _LEAP_DOWN = (int(_UP[-1]) * BASE) % 2**64, (int(_DOWN[-1]) * pow(BASE, -1, 1 << 64)) % 2**64


def power(base_low: np.ndarray, leap: int, n: int) -> np.ndarray:
    """The first n powers, from a table of the low ones and a leap over it."""
    rows = -(-n // _STEP)
    return (_powers(leap, rows)[:, None] * base_low[None, :]).ravel()[:n] if n else np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``values[start:end]`` of random 64-bit values: equal spans have equal hashes."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power(_UP, _LEAP_UP, n), out=total[1:])
    down = power(_DOWN, _LEAP_DOWN, n + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a batch of UTF-8 texts."""

    def __init__(self, texts: Iterable[bytes], lower: bool = False):
        texts = list(texts)
        self.joined = b"\n".join(texts) + b"\n"
        if lower:
            self.joined = self.joined.lower()  # bytes: A-Z alone
        self.bytes = np.frombuffer(self.joined, np.uint8)
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = ~WHITE[self.bytes]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        #: Word ``first[i]`` to ``first[i + 1]`` are those of text i.
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, in passes over about BLOCK bytes."""
        out = np.empty(len(self.starts), np.uint64)
        done = 0
        while done < len(out):
            at = int(self.starts[done])
            upto = max(done + 1, int(np.searchsorted(self.ends, at + BLOCK, "right")))
            out[done:upto] = span_hashes(BYTE_VALUE[self.bytes[at : self.ends[upto - 1]]], self.starts[done:upto] - at, self.ends[done:upto] - at)
            done = upto
        return out

    def word(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every row, one row after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of strings, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
