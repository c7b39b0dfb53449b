"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of a generated method beyond which HotSpot never compiles it.
HUGE_METHOD_CONF, HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit", 8000


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # wide panels build thousands of column expressions; call-site tracking triples their cost
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(HUGE_METHOD_CONF, HUGE_METHOD)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_methods(spark: SparkSession) -> None:
    """Keep a stage's generated methods at a size that HotSpot compiles; a smaller limit of the session stays.

    A wide panel makes longer ones in a single fused stage, which run in the bytecode interpreter for every cell. Beyond
    the limit Spark evaluates the same expressions in split methods.
    """
    if int(spark.conf.get(HUGE_METHOD_CONF)) > HUGE_METHOD:
        spark.conf.set(HUGE_METHOD_CONF, HUGE_METHOD)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; fall back to a temporary one only in local mode."""
    if spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellframe-checkpoint-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, on the storage every executor sees."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str, turns: int = 1) -> DataFrame:
    """Deal rows out by their keys over as many tasks as the session has cores, ``turns`` tasks a core.

    For rows that are few bytes but much work, which adaptive execution would merge into one or two tasks.
    """
    return df.repartition(turns * df.sparkSession.sparkContext.defaultParallelism, *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written rows.

    Used where one expensive result is read by several branches, so that it is
    computed once and survives the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, for wide rows: written as compressed columns, of which a reader takes those it needs."""
    folder = scratch_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
