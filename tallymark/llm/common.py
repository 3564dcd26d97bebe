"""What several text operators share: the scratch folder, staged tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token of the text contracts: a run of characters that are neither space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where the master is local."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
    return context.getCheckpointDir()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and the shuffles behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def filtered(spark: SparkSession, ids: int):
    """Within the block Spark filters the larger side of a join, before its shuffle, by a Bloom filter of so many ids of the other side.

    The filter has 8 bits an id, 2^26 at most. The ids must be read with some condition, or Spark does not take them for selective.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    values = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 40), "expectedNumItems": str(max(1, min(ids, 4_000_000))), "numBits": str(max(64, min(8 * ids, 1 << 26)))}
    with ExitStack() as stack:
        for key, value in values.items():
            stack.enter_context(setting(spark, name + key, value))
        yield


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by Spark's own view of the store."""
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()).exists(there)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, away: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not in ``away`` (doc_id, h: xxhash64 of the text); columns as they were.

    Rows without a doc_id stay. Names of other columns don't matter.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    gone = away.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    return own.join(gone, ["_id", "_h"], "left_anti").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches of a few MB, so that a worker's memory does not follow the length of texts times a row count.

    The setting stays with the session: the plans made under it run later.
    """
    spark.conf.set(BATCH_BYTES, str(megabytes << 20))
