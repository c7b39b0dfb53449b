"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level k holds, for every id that has a chunk k, that chunk and a bit that says
whether another chunk follows. The ids with a further chunk keep their order on the next level, so the place of an id
there is the number of set bits before it: a directory holds that count for every 64-bit word. Any id is read by
itself from one chunk, one bit and one count a level, without decoding a block.

A file holds the ids of consecutive documents in ascending order of doc_id (nulls first, equal ids in order of a hash of
their text), with the documents' ids and their first places. Files are rows of a Parquet table written by Spark to the shared
folder, so a task that runs again leaves no half-written file: (part, seq, n_ids, file). ``part`` follows the order
of doc_id and ``seq`` counts within it.

A null text is an empty one and has the end id alone; repeated rows are kept.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.llm.pieces import PieceIds
from cellframe.session import scratch_folder

MAGIC = b"DAC1"
CHUNK = 8
END_ID = 0
#: Ids after which a file is closed.
FILE_IDS = 1 << 20
#: Ids looked up together.
READ_IDS = 1 << 16


class Codes:
    """Directly addressable codes over one buffer."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, n_levels = struct.unpack_from("<QB", data, at)
        at += 9
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, 8 * words, at + n).view("<u8")
            ranks = np.frombuffer(data, np.uint8, 4 * words, at + n + 8 * words).view("<u4")
            at += n + 12 * words
            self.levels.append((chunks, bits, ranks))
        self.end = at

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        parts, n_levels = [], 0
        rest = values
        while len(rest):
            more = rest >> np.uint64(CHUNK) > 0
            words = -(-len(rest) // 64)
            bits = np.zeros(8 * words, np.uint8)
            packed = np.packbits(more, bitorder="little")
            bits[: len(packed)] = packed
            set_ = np.bitwise_count(bits.view("<u8")).astype(np.uint32)
            parts += [struct.pack("<Q", len(rest)), (rest & np.uint64(255)).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(set_, dtype=np.uint32) - set_).tobytes()]
            rest, n_levels = rest[more] >> np.uint64(CHUNK), n_levels + 1
        return struct.pack("<QB", len(values), n_levels) + b"".join(parts)

    def read(self, places: np.ndarray) -> np.ndarray:
        """The values at any places."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("place outside the file")
        out, mine, shift = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        for chunks, bits, ranks in self.levels:
            if not len(at):
                break
            out[mine] |= chunks[at].astype(np.uint64) << np.uint64(shift)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            more = bits[word] >> bit & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at, mine = (ranks[word].astype(np.int64) + below)[more], mine[more]
            shift += CHUNK
        return out

    def checksum(self, first: int, n: int) -> int:
        """CRC-32 of n values from a place on, as little-endian unsigned 32-bit integers; READ_IDS of them at a time."""
        crc = 0
        for at in range(first, first + n, READ_IDS):
            crc = zlib.crc32(self.read(np.arange(at, min(at + READ_IDS, first + n))).astype("<u4").tobytes(), crc)
        return crc


def pack_file(doc_ids: list[int | None], firsts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes: the number of documents, which have an id, their ids and first places, then the codes."""
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    own = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return MAGIC + struct.pack("<Q", len(doc_ids)) + known + own + firsts.astype("<i8").tobytes() + Codes.pack(ids)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    if data[:4] != MAGIC:
        raise ValueError("not a file of codes")
    (n,) = struct.unpack_from("<Q", data, 4)
    known = np.frombuffer(data, np.uint8, n, 12)
    own, firsts = np.frombuffer(data, "<i8", n, 12 + n), np.frombuffer(data, "<i8", n, 12 + 9 * n)
    return [d if k else None for d, k in zip(own.tolist(), known.tolist())], firsts, Codes(data, 12 + 17 * n)


class LibraryIds:
    """Ids by the tokenizers library, which gets every different match of its split pattern once in a while.

    Added tokens (``<|endoftext|>``) in a text are matched before the pattern, as the library does by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library takes some microseconds a piece, so the table has room for two million
        self.pieces = PieceIds(lambda strings: [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)], bits=22)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Tokens that take white space with them, or hold as whole words alone, are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized and not t.special for t in added.values())
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def of_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held: list[str] = []
        for text in texts:
            if self.cuts is None or not self.cuts.search(text):
                held.append(text)
                continue
            yield from self.pieces.of_texts(held)
            held = []
            if not self.plain:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            parts = self.cuts.split(text)  # every second one is an added token
            between = self.pieces.of_texts(parts[::2])
            ids = [next(between)]
            for token, more in zip(parts[1::2], between):
                ids += [np.array([self.added[token]], np.uint32), more]
            yield np.concatenate(ids)
        yield from self.pieces.of_texts(held)


@lru_cache(2)
def library(path: str) -> LibraryIds:
    """The ids of one tokenizer file, made once in a process."""
    return LibraryIds(path)


def write(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Write the ids of every row's ``text``, each followed by END_ID, and return the table's folder."""
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seq = library(path), TaskContext.get().partitionId(), 0
        owners: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal owners, held, size, seq
            firsts = np.cumsum([0, *map(len, held)])[:-1]
            data = pack_file(owners, firsts, np.concatenate(held))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "file"])
            owners, held, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), table.of_texts([x or "" for x in batch.column(1).to_pylist()])):
                owners.append(doc_id)
                held.append(np.append(ids, np.uint32(END_ID)))
                size += len(ids) + 1
                if size >= FILE_IDS:
                    yield close()
        if owners:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    files = ordered.mapInArrow(run, "part int, seq long, n_ids long, file binary")
    files.write.option("compression", "zstd").parquet(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.parquet(folder)
    # one row a part, so the running sum is over as many rows as there were writing tasks
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    seqs = files.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before_file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                owners, firsts, codes = read_file(data)
                counts = np.diff(np.append(firsts, codes.n))
                crc = [codes.checksum(a, n) for a, n in zip(firsts.tolist(), counts.tolist())]
                n = len(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.full(n, part, np.int32), np.full(n, seq))] + [pa.array(owners, pa.int64()), pa.array(firsts.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "file").mapInArrow(run, "part int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    placed = rows.join(seqs.join(parts, "part"), ["part", "seq"])
    return placed.select("doc_id", (F.col("before_part") + F.col("before_file") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
