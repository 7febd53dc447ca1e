"""Streaming ingestion: files or rows as they arrive, cleaned and chunked, repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.functions.text import clean_text
from lectern.operators.chunking import exploded, fixed_chunks
from lectern.options import ChunkOptions, CleaningOptions


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unrepeated(stream: DataFrame, event_time: str, text: str = "text", delay: str = "1 hour") -> DataFrame:
    """Rows whose text hasn't come within the watermark's delay."""
    keyed = stream.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def chunk_stream(
    stream: DataFrame,
    *keep: str,
    text: str = "text",
    o: ChunkOptions = ChunkOptions(),
    cleaning: CleaningOptions = CleaningOptions(normalize_unicode=False, max_length=10**9),
) -> DataFrame:
    """Stateless: cleaned word windows of each row, of the whole text unless ``cleaning`` bounds it."""
    cleaned = stream.withColumn(text, clean_text(F.col(text), cleaning))
    return exploded(cleaned, fixed_chunks(F.col(text), o), *keep)


def append_to(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch appended under its number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, event_time: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows by window of arrival, for monitoring."""
    w = F.window(event_time, width)
    counts = stream.withWatermark(event_time, delay).groupBy(w).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
