"""Sources: classification, guards, dispatch, cache tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed parts of content types, in the order in which they are tried.
DOCUMENT_TYPES = (
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument",
    "application/vnd.ms-excel",
    "text/plain",
    "text/csv",
)


def is_url(c: Column) -> Column:
    return F.coalesce(c.startswith("http://") | c.startswith("https://"), F.lit(False))


def is_bin(c: Column) -> Column:
    return F.coalesce(F.lower(c).endswith(".bin"), F.lit(False))


def url_type(status: Column, content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    document = F.lit(False)
    for t in DOCUMENT_TYPES:
        document = document | F.contains(kind, F.lit(t))
    return (
        F.when(status.isNull() | (status != 200), "error")
        .when(document, "document")
        .when(F.contains(kind, F.lit("application/json")), "api")
        .when(F.contains(kind, F.lit("text/html")), "web")
        .otherwise("unknown")
    )


def local_path(c: Column) -> Column:
    """Path of a ``file:`` source; one or three slashes make the same absolute path."""
    return F.when(c.startswith("file:"), F.regexp_replace(c, "^file:/*", "/")).otherwise(c)


def fetched_name(url: Column, content_type: Column) -> Column:
    """File name of a fetched source, with an extension guessed if it has none."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    last = F.element_at(F.split(bare, "/"), -1)
    name = F.when(last == "", F.lit("document")).otherwise(last)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    guess = F.when(F.contains(kind, F.lit("pdf")), ".pdf").when(F.contains(kind, F.lit("image")), ".jpg").otherwise(".txt")
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, guess))


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]*)$", 1))


def file_type(source: Column) -> Column:
    return F.when(F.contains(source, F.lit(".")), F.regexp_extract(source, r"[^/\\](\.[^./\\]*)$", 1)).otherwise("unknown")


def cache_key(source: Column, modified: Column | None = None, length: Column | None = None) -> Column:
    """md5 of a URL; of path, time and size for a file whose state is known."""
    if modified is None or length is None:
        return F.md5(source.cast("binary"))
    state = F.concat_ws(":", source, modified.cast("string"), length.cast("string"))
    known = ~is_url(source) & modified.isNotNull() & length.isNotNull()
    return F.md5(F.when(known, state).otherwise(source).cast("binary"))


def content_key(name: Column, content: Column) -> Column:
    return F.concat(name, F.lit("_"), F.substring(F.sha2(content, 256), 1, 16))


def uncached(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources (with cache_key) that the cache table doesn't hold."""
    return sources.join(cache.select("cache_key"), "cache_key", "left_anti")


def cached(sources: DataFrame, cache: DataFrame) -> DataFrame:
    return sources.join(cache, "cache_key")


def cache_stats(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses, saves, hit_rate and entries for requests (with cache_key)."""
    known = cache.select("cache_key").distinct().withColumn("known", F.lit(True))
    counted = requests.join(known, "cache_key", "left").agg(
        F.count_if("known").alias("hits"), F.count_if(F.col("known").isNull()).alias("misses")
    )
    entries = cache.agg(F.countDistinct("cache_key").alias("entries"))
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0))
    return counted.crossJoin(entries).select(
        "hits", "misses", F.col("misses").alias("saves"), F.format_string("%.2f%%", rate * 100).alias("hit_rate"), "entries"
    )


def routed(fetched: DataFrame) -> DataFrame:
    """(source, status, content_type, ...) with url_type, file name and extractor route; guards come first."""
    kind = url_type(F.col("status"), F.col("content_type"))
    route = (
        F.when(is_bin(F.col("source")), "rejected")
        .when(~is_url(F.col("source")), "file")
        .when(kind == "error", "failed")
        .when(kind == "unknown", "document")
        .otherwise(kind)
    )
    return fetched.withColumns(
        {"url_type": kind, "route": route, "filename": fetched_name(F.col("source"), F.col("content_type"))}
    )


def ingestion(extracted: DataFrame) -> DataFrame:
    """(source, success): whether a source gave any text."""
    ok = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return extracted.groupBy("source").agg(F.bool_or(ok).alias("success"))


def parse_summary(extracted: DataFrame) -> DataFrame:
    """total and successful sources."""
    return extracted.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))).alias("successful"))
