"""Staged tables in the folder that all executors share, and global row numbers."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    # Without this, the shuffle files of a finished write stay until the driver happens to collect its garbage.
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in ``order``, without a window over all rows.

    Rows are dealt by ranges and staged with their range; counts by range (one
    a partition) give the offsets.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    counts = sorted(tuple(r) for r in dealt.groupBy("_range").count().collect())
    starts = [0, *accumulate(c for _, c in counts)][: len(counts)]
    before = df.sparkSession.createDataFrame([(k, s) for (k, _), s in zip(counts, starts)], "_range int, _before long")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_before", "_nth")


def spread(df: DataFrame, parts: int) -> DataFrame:
    """``df`` dealt out to ``parts`` tasks; 0: left as it is."""
    return df.repartition(parts) if parts else df
