"""Materialised intermediates in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only in local mode (tests), where that is unset, a local one is set.

    It goes when the driver's JVM ends: results that still read it are those of the same session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    out = f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file system client."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Most rows and bytes of an Arrow batch between the JVM and Python: whole texts are long, and both sides hold batches beside the heap.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batch limits to ours, unless its row limit is lower already."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Spark's setting by which an execution deletes its shuffle files when it ends, instead of whenever the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as Parquet files, read back. The shuffles that made them are gone by then: nothing reads them again, as each write plans its own."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Writes frames as Parquet and reads them back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)
        bounded_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.root}/{name}")

    def measured(self, df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
        """``save`` and aggregates of the rows (0 without any), taken as they are written: no pass of their own."""
        seen = Observation()
        out = self.save(df.observe(seen, *(c.alias(k) for k, c in sums.items())), name)
        return out, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, f"{self.root}/{name}")


#: Bytes of input for each task of a shuffle that carries a share of it, and the most tasks of one shuffle.
TASK_BYTES, MOST_TASKS = 16 << 20, 1 << 17


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's bytes, which for a scan is that of its files' columns; 0 where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def reduce_width(df: DataFrame) -> int:
    """Partitions for a shuffle that carries a share of the input: by its bytes, whatever the size of the scan's splits, and at least as many as these."""
    spark = df.sparkSession
    bounded_batches(spark)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), min(-(-input_bytes(df) // TASK_BYTES), MOST_TASKS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_text(col) -> F.Column:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")
