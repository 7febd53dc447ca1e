"""Dispatch of fetched sources to their extractors, with a cache table before all work; page assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fused_text, needs_ocr
from lectern.options import CleaningOptions
from lectern.plans.staging import staged
from lectern.sources.extract import api_text, extract, fetched, web_text
from lectern.sources.routing import cache_key, is_bin, routed

CACHE = "cache_key string, source string, text string, url_type string, cached_at timestamp"


def parsed(content: DataFrame, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """(source, url_type, text, status, error) of (source, status, content_type, content): one row a source.

    Web pages, API responses and documents take their own branch; what can't be
    read or gives no text is a failed row.
    """
    rows = routed(content)
    body = F.decode("content", "UTF-8")
    web = web_text(rows.where(F.col("route") == "web").select("source", "url_type", body.alias("html")), options)
    api = api_text(rows.where(F.col("route") == "api").select("source", "url_type", body.alias("body")), "body", options)
    files = rows.where(F.col("route").isin("document", "file"))
    document = extract(files.select("source", "filename", "content"), options).select("source", "text", "error")
    document = document.join(files.select("source", "url_type").distinct(), "source")
    none = F.lit(None).cast("string")
    refused = rows.where(F.col("route").isin("failed", "rejected")).select(
        "source", "url_type", F.lit("").alias("text"), F.when(F.col("route") == "rejected", "binary files are refused").otherwise("the source could not be fetched").alias("error")
    )
    both = [x.select("source", "url_type", "text", none.alias("error")) for x in (web, api)]
    whole = both[0].unionByName(both[1]).unionByName(document.select("source", "url_type", "text", "error")).unionByName(refused)
    filled = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return whole.select(
        "source",
        "url_type",
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(filled, "success").otherwise("failed").alias("status"),
        F.when(~filled, F.coalesce("error", F.lit("no text was found"))).alias("error"),
    )


def cached_parse(
    sources: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]], cache: DataFrame | None = None, options: CleaningOptions = CleaningOptions()
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sources`` and the cache's new entries; only sources that the cache lacks are fetched."""
    keyed = sources.select("source", cache_key(F.col("source")).alias("cache_key")).distinct()
    fresh = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    bins = fresh.where(is_bin(F.col("source"))).select(
        "source", F.lit("error").alias("url_type"), F.lit("").alias("text"), F.lit("failed").alias("status"), F.lit("binary files are refused").alias("error")
    )
    done = staged(parsed(fetched(fresh, fetch), options).unionByName(bins), "parsed")
    entries = done.where(F.col("status") == "success").select(
        cache_key(F.col("source")).alias("cache_key"), "source", "text", "url_type", F.current_timestamp().alias("cached_at")
    )
    if cache is None:
        return done, entries
    held = keyed.join(cache.select("cache_key", "text", "url_type"), "cache_key")
    known = held.select("source", "url_type", "text", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(known), entries


def save_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def clear_cache(spark, path: str) -> bool:
    """Delete the cache table; True if there was one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_expired(spark, path: str) -> int:
    """Entries don't expire: always 0."""
    return 0


def assembled_pages(pages: DataFrame, hybrid: bool = True, key: str = "source") -> DataFrame:
    """(key, text, ocr_used) of (key, page, digital, ocr, area): poor pages take or add the recognised text, in page order."""
    poor = needs_ocr(F.col("digital"), F.col("area")) & F.coalesce(F.col("ocr") != "", F.lit(False))
    text = F.when(poor, fused_text(F.col("digital"), F.col("ocr")) if hybrid else F.col("ocr")).otherwise(F.coalesce("digital", F.lit("")))
    rows = pages.select(key, "page", text.alias("t"), poor.alias("poor"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("x"), F.bool_or("poor").alias("ocr_used"))
    filled = F.filter(F.transform("x", lambda r: r["t"]), lambda t: t.rlike(r"(?U)\S"))
    return listed.select(key, F.array_join(filled, "\n\n").alias("text"), "ocr_used")


def best_attempt(attempts: DataFrame, *keys: str, text: Column | str = "text") -> DataFrame:
    """The longest of several recognitions of a page; of equal lengths the first in order."""
    t = F.col(text) if isinstance(text, str) else text
    return attempts.groupBy(*keys).agg(F.max_by(t, F.struct(F.length(t), -F.col("attempt"))).alias("text"))
