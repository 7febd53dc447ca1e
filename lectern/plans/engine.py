"""The lifecycle as plans: sources to chunks, chunks to an index, questions to answers; and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.answer import EMPTY_SOURCES, Generator, answers
from lectern.operators.chunking import raw_chunks, resized
from lectern.operators.embedding import Embedder, HashingEmbedder
from lectern.operators.neardup import greedy_unique, merged_texts
from lectern.operators.search import Index, build_index
from lectern.options import ChunkOptions
from lectern.plans.staging import numbered, spread, staged
from lectern.sources.routing import file_type


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", o: ChunkOptions = ChunkOptions(), keep_metadata: bool = False, parts: int = 0) -> DataFrame:
    """Final chunks of each document: all strategies, repeats dropped, by start, cut to size, merged.

    A document's chunks stay in one row's array from end to end, so nothing is
    shuffled; only the two greedy steps run in Python. Their work grows with the
    square of a document's chunks. ``parts``: tasks to deal documents to, where
    the table comes in too few.
    """
    fields = ["start_idx", "end_idx", "chunk_type", "num_sentences", "num_paragraphs", "resized"]
    body = spread(docs.select(key, text), parts).where(F.col(text).rlike(r"(?U)\S")).select(F.col(key).alias("_key"), raw_chunks(F.col(text), o).alias("_raw"))

    def dropped(texts: pd.Series) -> pd.Series:
        return pd.Series([greedy_unique(list(t), o) for t in texts], dtype=object)

    kept = F.pandas_udf(dropped, T.ArrayType(T.IntegerType()))(F.transform("_raw", lambda x: x["text"]))
    body = body.withColumn("_kept", kept)
    by_start = F.array_sort(F.transform("_kept", lambda i: F.struct(F.get("_raw", i)["start_idx"].alias("s"), i.alias("i"), F.get("_raw", i).alias("c"))))
    cut = body.select("_key", resized(F.transform(by_start, lambda x: x["c"]), o).alias("_cut"))
    cut = cut.select("_key", F.transform("_cut", lambda x: x["text"]).alias("_text"), *[F.get("_cut", F.lit(0))[c].alias(c) for c in fields])
    schema = T.StructType([cut.schema["_key"], T.StructField("chunk_pos", T.IntegerType()), T.StructField("text", T.StringType()), *cut.schema.fields[2:]])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [[t for t, _ in merged_texts(x, None, o)] for x in b.column(1).to_pylist()]
            row = pa.array([k for k, x in enumerate(texts) for _ in x], pa.int64())
            place = pa.array([p for x in texts for p in range(len(x))], pa.int32())
            rest = [b.column(k).take(row) if keep_metadata else pa.nulls(len(row), b.column(k).type) for k in range(2, b.num_columns)]
            arrays = [b.column(0).take(row), place, pa.array([t for x in texts for t in x], pa.string()), *rest]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return cut.mapInArrow(merged, schema).withColumnRenamed("_key", key)


def ingested(sources: DataFrame, source: str = "source", text: str = "text", o: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of (source, text) with source, file_type, global pos and chunk_id, in the order of sources."""
    chunks = chunked(sources, source, text, o).withColumn("file_type", file_type(F.col(source)))
    chunks = chunks.withColumn("processing_timestamp", F.unix_micros(F.current_timestamp()) / 1e6)
    placed = numbered(chunks, source, "chunk_pos")
    return placed.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("pos").cast("string")))


def index_of(docs: DataFrame, source: str = "source", text: str = "text", embedder: Embedder | None = None) -> Index:
    return build_index(ingested(docs, source, text), embedder or HashingEmbedder())


def ask(docs: DataFrame, queries: DataFrame, strategy: str = "ensemble", generator: Generator | None = None, source: str = "source") -> DataFrame:
    """(query_id, answer, confidence_score) over (source, text); without any text, the answer says so."""
    chunks = staged(ingested(docs, source), "ingested")
    if chunks.isEmpty():
        return queries.select("query_id", F.lit(EMPTY_SOURCES).alias("answer"), F.lit(0.0).alias("confidence_score"))
    return answers(build_index(chunks, HashingEmbedder()), queries, strategy, generator)


def index_stats(chunks: DataFrame) -> DataFrame:
    """total_chunks and unique_sources."""
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.countDistinct(F.coalesce("source", F.lit("unknown"))).alias("unique_sources")
    )


def chunk_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("n_chunks"))


def search_stats(index: Index) -> DataFrame:
    """total_chunks, whether the lexical and vector indexes are there, and the size of the vectors."""
    chunks = index.chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    lexical = F.lit(index.postings is not None).alias("lexical_built")
    if index.vectors is None:
        return chunks.select("total_chunks", lexical, F.lit(False).alias("vectors_built"), F.lit(None).cast("long").alias("dimension"))
    size = index.vectors.agg(F.max(F.size("embedding")).cast("long").alias("dimension"))
    return chunks.crossJoin(F.broadcast(size)).select("total_chunks", lexical, F.lit(True).alias("vectors_built"), "dimension")
