"""Byte-level BPE encoding and decoding by monoid tree reduction.

The pattern splits a text (see ``pieces``); each match is encoded by itself. A match of up to LEAF bytes is a leaf:
leaves are merged together, rank by rank, as arrays. A longer match is halved recursively. Two encoded neighbours
are joined by encoding a window of tokens around the seam again; it grows until its outer tokens are compatible with
the tokens outside. Two tokens are compatible if encoding their bytes gives these two again, and a sequence is the
encoding of its bytes exactly when all its neighbours are compatible, so then the outside is proven to stay.
Decoding concatenates bytes up the same kind of tree.

A null text is an empty one and has no tokens; a null doc_id and repeated rows are kept. Texts may have any length:
both the splitting and the encoding work on parts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.pieces import PieceIds, Slots
from cellframe.llm.text import mix, ragged

LEAF = 32
#: Bytes whose leaves are merged together; a place among them takes PLACE_BITS bits.
PASS_BYTES, PLACE_BITS = 1 << 21, 22
NONE = np.int64(1) << 40
#: Ids of one leaf of the decoding tree.
DECODE_LEAF = 1 << 16


class Merges:
    """The rank file as tables: bytes of an id, id of bytes, and the id that two neighbours merge into."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, to = np.array(pairs, np.int64).T
        self.pairs = Slots(20)
        self.pairs.add(self._key(left, right), to.astype(np.int32))
        self.fits: dict[tuple[int, int], bool] = {}
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.flat, self.size, self.first = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix((left << 32 | right).astype(np.uint64))

    def leaves(self, parts: list[bytes]) -> list[list[int]]:
        """Encode many byte strings of at most LEAF bytes, in passes of PASS_BYTES."""
        step = PASS_BYTES // LEAF
        return [ids for at in range(0, len(parts), step) for ids in self._leaves(parts[at : at + step])]

    def _leaves(self, parts: list[bytes]) -> list[list[int]]:
        """In each round, every string merges its leftmost pair of lowest rank."""
        out: list[list[int]] = [[] for _ in parts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        owner, tokens = np.repeat(np.arange(len(parts)), sizes), self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
        while len(tokens):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(tokens), NONE)
            to = self.pairs.get(self._key(tokens[:-1], tokens[1:])).astype(np.int64)
            rank[:-1] = np.where(same & (to >= 0), to, NONE)
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank << PLACE_BITS | np.arange(len(tokens)), heads)
            done = (best >> PLACE_BITS) >= NONE
            if done.any():
                counts = np.diff(np.append(heads, len(tokens)))
                flat, ended = tokens.tolist(), heads[done]
                for o, a, n in zip(owner[ended].tolist(), ended.tolist(), counts[done].tolist()):
                    out[o] = flat[a : a + n]
                best = best[~done]
                keep = np.repeat(~done, counts)
            else:
                keep = np.ones(len(tokens), bool)
            at = best & ((1 << PLACE_BITS) - 1)
            tokens[at] = best >> PLACE_BITS
            keep[at + 1] = False
            tokens, owner = tokens[keep], owner[keep]
        return out

    def few(self, data: bytes) -> list[int]:
        """Encode a few bytes by merging the lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (a, b) not in self.fits:
            if len(self.fits) > 1 << 18:
                self.fits.clear()
            self.fits[a, b] = self.few(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.fits[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        reach = 1
        while True:
            own = left[-reach:] + right[:reach]
            own = self.few(b"".join(map(self.bytes_of.__getitem__, own))) if len(own) <= 2 * LEAF else self.tree(b"".join(map(self.bytes_of.__getitem__, own)))
            rest, after = left[:-reach], right[reach:]
            if (not rest or self.compatible(rest[-1], own[0])) and (not after or self.compatible(own[-1], after[0])):
                return rest + own + after
            if not rest and not after:
                return own
            reach *= 2

    def tree(self, data: bytes) -> list[int]:
        """Encode one long match: leaves together, then neighbours joined level by level."""
        level = self.leaves([data[i : i + LEAF] for i in range(0, len(data), LEAF)])
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode_many(self, strings: list[str]) -> list[list[int]]:
        parts = [s.encode() for s in strings]
        out: list[list[int]] = [[]] * len(parts)
        short = [i for i, p in enumerate(parts) if len(p) <= LEAF]
        for i, ids in zip(short, self.leaves([parts[i] for i in short])):
            out[i] = ids
        for i, p in enumerate(parts):
            if len(p) > LEAF:
                out[i] = self.tree(p)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: of the halves, concatenated."""
        if len(ids) > DECODE_LEAF:
            mid = len(ids) // 2
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        return self.flat[ragged(self.first[ids], self.size[ids])].tobytes()


@lru_cache(2)
def coder(path: str) -> tuple[Merges, PieceIds]:
    """The tables of one rank file, made once in a process."""
    merges = Merges(path)
    return merges, PieceIds(merges.encode_many)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = coder(path)
        for batch in batches:
            for ids, rows in _parts(batch, table):
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*rows), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _parts(batch: pa.RecordBatch, table: PieceIds, most: int = 1 << 22) -> Iterator[tuple[list[np.ndarray], tuple[int, int]]]:
    """The ids of a batch's rows, in parts of about ``most`` ids, each with its first row and length."""
    held, size, first = [], 0, 0
    for ids in table.of_texts([x or "" for x in batch.column(1).to_pylist()]):
        held.append(ids)
        size += len(ids)
        if size >= most:
            yield held, (first, len(held))
            held, size, first = [], 0, first + len(held)
    if held:
        yield held, (first, len(held))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and data (bytes) of every row's ``ids``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = coder(path)
        for batch in batches:
            data = [merges.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256 (of the decoded bytes).

    Encodes, decodes the ids and digests both in one pass over the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, table = coder(path)
        for batch in batches:
            counts, ids_hash, data_hash = [], [], []
            for ids, _ in _parts(batch, table):
                for x in ids:
                    counts.append(len(x))
                    ids_hash.append(hashlib.sha256(" ".join(map(merges.text_of.__getitem__, x.tolist())).encode()).hexdigest())
                    data_hash.append(hashlib.sha256(merges.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
