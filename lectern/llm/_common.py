"""Shared plumbing: table reads, staged tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a notebook on one machine) a local
    temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Survives the loss of any executor, and non-deterministic columns (row ids)
    are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def spread_join(rows: DataFrame, named: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has one row a key and in column ``n`` how many of ``rows`` hold it.

    A key that over a ``share``-th of all rows hold is met by a broadcast: there
    are fewer than ``share`` of them, however large the tables. All others are
    met by an exchange in which no key is large.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * share > F.lit(total)
    few, rest = named.where(hot).drop(n), named.where(~hot).drop(n)
    apart = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(few), key).unionByName(apart)


def python_workers_see_library(spark: SparkSession) -> None:
    """Put this library on the Python workers' path, if it isn't installed there."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_REPO, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
