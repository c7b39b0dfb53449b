"""A table of documents in packs: consecutive rows of about PACK_BYTES of text as one compressed Arrow stream.

A pack is what an exchange by content answers to: it sends its distinct keys to the shards and gets their answers back
under its own number. Packs are written once to the shared folder, without a shuffle, so that every later step sees
the same packs, whatever tasks run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.session import cut, scratch_folder

PACK_BYTES = 4 << 20
SCHEMA = "pack long, n_bytes long, rows binary"


def squeeze(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        for batch in rows:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_pack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def write(docs: DataFrame) -> DataFrame:
    """The packs of ``docs`` (with a column ``text``), read back from the folder they were written to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0)
            sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at, before = 0, 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, before + PACK_BYTES - size, "right")))
                held.append(batch.slice(at, upto - at))
                size += int(sizes[upto - 1]) - before
                at, before = upto, int(sizes[upto - 1])
                if size >= PACK_BYTES or at < batch.num_rows:
                    yield row(number, size, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield row(number, size, held)

    def row(number: int, size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([squeeze(held)], pa.binary())], ["pack", "n_bytes", "rows"])

    folder = scratch_folder(docs.sparkSession, "packs")
    docs.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def n_shards(packs: DataFrame, shard_bytes: int) -> int:
    """Shards of about ``shard_bytes`` of text each."""
    return max(1, -(-int(packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]) // shard_bytes))


def frequent(table: DataFrame, values_of: Callable[[pa.Table], np.ndarray], share: float) -> np.ndarray:
    """Values (uint64) with at least ``share`` of all that the packs have, sorted; at most 2 / share of them.

    A pack reports what has half that share of the pack, so what other packs leave out of a value that frequent is
    less than half of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                values = values_of(open_pack(data))
                value, n = np.unique(values, return_counts=True)
                much = n >= max(2, share / 2 * len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(value[much], np.uint64(0)).view(np.int64)), pa.array(np.append(n[much], len(values)).astype(np.int64)), pa.array([False] * int(much.sum()) + [True])],
                    ["value", "n", "total"],
                )

    counted = table.select("rows").mapInArrow(run, "value long, n long, total boolean").groupBy("total", "value").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    total = counted.where("total").agg(F.sum("n")).first()[0] or 0
    kept = counted.where(~F.col("total") & (F.col("n") >= max(2.0, share / 2 * total))).orderBy(F.desc("n"), "value").limit(int(2 / share))
    return np.array(sorted(r.value for r in kept.select("value").collect()), np.int64).view(np.uint64)


def narrow(values: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of every value."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def widen(data: np.ndarray, n: int) -> np.ndarray:
    """The values that ``narrow`` cut to n bytes."""
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(-1, n)
    return out.view("<u8").ravel()


def to_bytes(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed string."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def from_bytes(data: bytes, *kinds: str) -> list:
    """What ``to_bytes`` packed; a kind is a NumPy type, or "bytes"."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).tolist()
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        part = raw[at : at + size]
        out.append(part if kind == "bytes" else np.frombuffer(part, kind))
        at += size
    return out
