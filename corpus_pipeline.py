"""The training-data pipeline: toxic documents go, near copies go, repeated passages go, leaks go, and what is left is tokenised.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet to the shared folder and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import bpe, decontaminate, simhash, substring, toxicity
from cellframe.llm.queries import table, tokenizer_file
from cellframe.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the model of ``labels`` doesn't call toxic; all columns of documents.

    Rows are judged by their text alone, so repeated rows share their fate; a row without doc_id is judged too.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (then of the smallest text hash)."""
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents, n_chars anew; a text of which nothing is left stays as an empty one.

    Documents that lose no word keep their text as it is.
    """
    kept = substring.dedup(docs, keep_unchanged=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", tokenise),
]

#: Learned scores, XXH64 fingerprints and BPE have no SQL; tests/llm/test_pipeline.py compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        folder = scratch_folder(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
