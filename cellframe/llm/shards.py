"""Contiguous shards of equal size from global prefix sums of bytes.

Documents lie in the order of doc_id (nulls first; equal ids by size and checksum). The bytes before each come from
per-partition totals (:mod:`cellframe.llm.order`). The table is cut at equal targets: a document belongs to the shard
that its middle byte falls into, so a shard's size is off its target by at most half a document at either end. A
size is the UTF-8 bytes of the text plus one.

Nulls: a null text has size 1 and the checksum of an empty one; a null doc_id is kept. Repeated rows are placed one
after the other, so a cut may fall between them; equal texts aren't kept together, which no shard of equal size could
hold where they are a third of all rows. A document larger than a target makes its shard as large as itself and may
leave a neighbour empty. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.order import positions
from cellframe.session import cut, scratch_folder

SHARDS, LAW = 8, "bytes"


def place(docs: DataFrame, n_shards: int = SHARDS, key: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in every shard) of every row; also ``key``, a column to find the row by."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *([F.col(key).alias("key")] if key else []),
    )
    ordered = cut(positions(rows, ["doc_id", "size", "text_crc32"], sums=["size"]))
    total = ordered.agg(F.max(F.col("before_size") + F.col("size"))).first()[0] or 1
    dealt = ordered.withColumn("shard", F.expr(f"cast((before_size * 2 + size) * {n_shards} div {2 * total} as int)"))
    firsts = dealt.groupBy("shard").agg(F.min("row_no").alias("first"))  # one row a shard
    return dealt.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first")).alias("slot"), *(["key"] if key else []))


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The digest of :func:`place`: doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law moves rows when it grows)."""
    return place(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, folder: str, n_shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` as Parquet, one folder ``_shard=<i>`` a shard, in the order of ``_slot``.

    The rows are numbered in a copy, by which each finds its place whatever repeats. A shard is written by several
    tasks, each with a range of its slots.
    """
    copy = scratch_folder(docs.sparkSession, "unsharded")
    docs.withColumn("_key", F.monotonically_increasing_id()).write.parquet(copy)
    rows = docs.sparkSession.read.parquet(copy)
    placed = place(rows, n_shards, key="_key").select(F.col("key").alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    dealt = rows.join(placed, "_key").drop("_key").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    dealt.write.partitionBy("_shard").parquet(folder)


#: CRC-32 in SQL: the table of 256 steps as a list.
CRC_TABLE_SQL = """
crc_bits(v, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS steps FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, next to ``crc_table`` in FROM."""
    data = f"list_transform(string_split(rtrim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' '), lambda h : ('0x' || h)::BIGINT)"
    return f"""CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}),
        lambda c, b : xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) END"""


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
rows AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(text, '') AS t FROM documents),
hashed AS (SELECT doc_id, size, {crc_sql("t")} AS text_crc32 FROM rows, crc_table),
summed AS (
    SELECT *, row_number() OVER o - 1 AS row_no, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
    FROM hashed WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
dealt AS (SELECT *, ((before * 2 + size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, '{LAW}' AS law, shard,
    (row_no - min(row_no) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""
