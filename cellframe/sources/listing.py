"""File listings as tables: paired arrays, core images and artifact hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.sources.files import FileSource, open_store

# Suffixes of the two arrays of a core.
PAIR_SUFFIXES = ("_HE.npy", "_CODEX.npy")


def files(spark: SparkSession, path: str, pattern: str = "*", digest: bool = False) -> DataFrame:
    """``path, length, sha256`` of the files under a folder; the digest is null, and no content read, unless asked for.

    Stores that only Spark's own readers reach are read by them, which takes files of up to 2 GB.
    """
    try:
        open_store(path)
    except Exception:  # no file system of that kind outside of Spark
        rows = (
            spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path)
        )
        return rows.select("path", "length", (F.sha2("content", 256) if digest else F.lit(None).cast("string")).alias("sha256"))
    spark.dataSource.register(FileSource)
    return spark.read.format(FileSource.name()).option("pattern", pattern).option("digest", str(digest).lower()).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files under a folder; the contents are not read."""
    return files(spark, path, pattern).select("path", "length")


def file_name(path: str = "path"):
    return F.element_at(F.split(F.col(path), "/"), -1)


def discover_pairs(listed: DataFrame, first: str = PAIR_SUFFIXES[0], second: str = PAIR_SUFFIXES[1]) -> DataFrame:
    """Names that have a file with either suffix, in order.

    One aggregation over the file names rather than a self-join.
    """
    name = file_name()
    base = F.when(name.endswith(first), F.expr(f"left(__name, length(__name) - {len(first)})")).when(
        name.endswith(second), F.expr(f"left(__name, length(__name) - {len(second)})")
    )
    return (
        listed.withColumn("__name", name).select(base.alias("basename"), F.col("__name").endswith(first).alias("__f"))
        .filter("basename is not null")
        .groupBy("basename")
        .agg(F.bool_or("__f").alias("__a"), F.bool_or(~F.col("__f")).alias("__b"))
        .filter("__a and __b").select("basename")
    )


def discover_cores(listed: DataFrame, suffix: str = ".tif") -> DataFrame:
    """``row, col`` of files named ``ROW-COL``; other files are ignored."""
    name = file_name()
    stem = F.expr(f"left(__name, length(__name) - {len(suffix)})")
    parts = F.split(stem, "-", 2)
    return (
        listed.withColumn("__name", name).filter(F.col("__name").endswith(suffix))
        .select(parts[0].alias("row"), F.when(F.size(parts) == 2, parts[1]).alias("__c"))
        .withColumn("col", F.expr("try_cast(__c as int)"))
        .filter("col is not null").select("row", "col")
    )


def artifact_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and SHA-256 of every file under a folder; equal names are flagged."""
    rows = files(spark, path, pattern, digest=True).select(file_name().alias("name"), F.col("length").alias("bytes"), "sha256")
    repeats = rows.groupBy("name").agg(F.count("*").alias("__n"))
    return rows.join(repeats, "name").select("name", "bytes", "sha256", (F.col("__n") > 1).alias("duplicate_name"))
