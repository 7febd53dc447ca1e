"""Indexes as tables, and search over them for whole batches of queries.

An index is a value: chunks, postings, document frequencies, lengths, corpus
totals and vectors, each a DataFrame. Every search takes a queries table and
returns ranked rows; text is joined back after the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import let, lexical_tokens, words
from lectern.operators.embedding import Embedder, embedded
from lectern.operators.neardup import merged_results
from lectern.options import SearchOptions
from lectern.plans.staging import staged

STRATEGIES = ("semantic", "lexical", "hybrid", "ensemble", "ensemble_parallel")


@dataclass(frozen=True)
class Index:
    """``chunks``: chunk_id, pos (order of ties, from 0), text, start_idx; the rest is derived.

    ``postings`` holds a row for each chunk (pos, dl, terms, tfs): a search goes
    through chunks in place, and a frequent term is never one partition.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    vectors: DataFrame | None = None
    embedder: Embedder | None = None

    TABLES = ("chunks", "postings", "terms", "corpus", "vectors")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            df = getattr(self, name)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, embedder: Embedder | None = None) -> Index:
        names = [n for n in cls.TABLES if n != "vectors" or embedder is not None]
        return cls(**{n: spark.read.parquet(f"{path}/{n}") for n in names}, embedder=embedder)


def postings_of(chunks: DataFrame) -> DataFrame:
    """(pos, dl, terms, tfs): runs of equal words in each chunk's sorted words, so that counting needs no shuffle."""

    def runs(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        told = lambda starts: F.struct(
            F.transform(starts, lambda i: F.get(w, i)).alias("terms"),
            F.transform(starts, lambda i, k: (F.coalesce(F.get(starts, k + 1), F.size(w)) - i).cast("long")).alias("tfs"),
            F.size(w).cast("long").alias("dl"),
        )
        none = F.struct(F.array().cast("array<string>").alias("terms"), F.array().cast("array<bigint>").alias("tfs"), F.lit(0).cast("long").alias("dl"))
        return F.when(F.size(w) > 0, let(first, told)).otherwise(none)

    sorted_words = F.sort_array(lexical_tokens(F.coalesce(F.col("text"), F.lit(""))))
    listed = chunks.select(F.col("pos").cast("long").alias("pos"), F.inline(F.array(let(sorted_words, runs))))
    return listed.select("pos", "dl", "terms", "tfs")


def term_weights(counts: DataFrame, corpus: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """(term, df, idf) of (term, df): negative weights become epsilon times the mean over the vocabulary."""
    raw = counts.crossJoin(F.broadcast(corpus)).select(
        "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    floor = F.lit(o.epsilon) * F.col("mean")
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def build_index(chunks: DataFrame, embedder: Embedder | None = None, o: SearchOptions = SearchOptions()) -> Index:
    """Index tables of ``chunks`` (chunk_id, pos, text, and start_idx if known), staged."""
    if "start_idx" not in chunks.columns:
        chunks = chunks.withColumn("start_idx", F.lit(0))
    chunks = staged(chunks.select("chunk_id", "pos", "text", F.coalesce("start_idx", F.lit(0)).alias("start_idx")), "chunks")
    postings = staged(postings_of(chunks), "postings")
    corpus = staged(postings.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "corpus")
    counts = staged(postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")
    terms = staged(term_weights(counts, corpus, o), "terms")
    vectors = None
    if embedder is not None:
        vectors = staged(embedded(chunks.select("chunk_id", "pos", "text"), embedder).drop("text"), "vectors")
    return Index(chunks, postings, terms, corpus, vectors, embedder)


def _top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with ``rank`` from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best (score, pos) of each query among the rows offered so far; ties by position."""

    def __init__(self, queries: int, k: int, latest_first: bool = False):
        self.k, self.sign = k, -1 if latest_first else 1
        self.score, self.pos = np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def offer(self, score: np.ndarray, pos: np.ndarray) -> None:
        """``score``: a row a query, a column a position."""
        for at in range(0, len(pos), 512):
            s = np.hstack([self.score, score[:, at : at + 512]])
            p = np.hstack([self.pos, np.broadcast_to(pos[at : at + 512], (len(s), len(pos[at : at + 512])))])
            order = np.lexsort((self.sign * p, -np.round(s, 9)), axis=1)[:, : self.k]
            self.score, self.pos = np.take_along_axis(s, order, 1), np.take_along_axis(p, order, 1)

    def rows(self, ids: list) -> Iterator[pa.RecordBatch]:
        n = self.score.shape[1]
        if n:
            names = pa.array([i for i in ids for _ in range(n)])
            yield pa.RecordBatch.from_arrays([names, pa.array(self.pos.ravel()), pa.array(self.score.ravel())], names=["query_id", "pos", "score"])


def _best_hits(parts: list[DataFrame], spark, kind: str, k: int, latest_first: bool = False) -> DataFrame:
    """The final k of each query out of each task's k, for all blocks of queries."""
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, pos long, score double, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _top(out, k, F.round("score", 9).desc(), F.desc("pos") if latest_first else F.asc("pos"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, pos, score, rank): the k largest inner products of each query, all vectors compared.

    Queries (query_id, embedding) go to the tasks in blocks of ``block``; a task
    multiplies matrices and keeps k rows of each query, so little is shuffled. A
    query meets the vectors of its own size; those with a null in them meet none.
    """
    spark = vectors.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    whole = lambda df: df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    slim = whole(vectors.select(F.col("pos").cast("long").alias("pos"), "embedding"))

    def search(rows: list, size: int) -> DataFrame:
        held = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best = _Best(len(ids), k)
            for b in batches:
                if b.num_rows:
                    m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    best.offer(q @ m.T, b.column(0).to_numpy())
            yield from best.rows(ids)

        return slim.where(F.size("embedding") == size).mapInArrow(run, f"query_id {kind}, pos long, score double")

    done: list[DataFrame] = []
    waiting: dict[int, list] = {}
    for r in whole(queries.select("query_id", "embedding")).toLocalIterator():
        part = waiting.setdefault(len(r[1]), [])
        part.append((r[0], r[1]))
        if len(part) == block:
            done.append(staged(search(waiting.pop(len(r[1])), len(r[1])), "hits"))
    done += [search(part, size) for size, part in waiting.items()]
    return _best_hits(done, spark, kind, k)


def semantic(index: Index, queries: DataFrame, o: SearchOptions = SearchOptions(), top_k: int | None = None) -> DataFrame:
    """(query_id, pos, score, rank): up to 3 * top_k rows over the threshold.

    Queries may bring an ``embedding`` of their own.
    """
    k = o.top_k if top_k is None else top_k
    asked = queries if "embedding" in queries.columns else embedded(queries, index.embedder, "query")
    hits = vector_topk(index.vectors, asked, 3 * k).where(F.col("score") >= o.semantic_threshold)
    return hits.where(F.col("rank") <= k) if o.strict_top_k else hits


def _weighted(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, weights): the known terms of each query with how often it names them times their weight."""
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(index.terms, "term")
    weights = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("weights"))
    return queries.select("query_id").distinct().join(weights, "query_id", "left")


def lexical(
    index: Index, queries: DataFrame, o: SearchOptions = SearchOptions(), top_k: int | None = None, latest_first: bool = False, block: int = 256, room: int = 8192
) -> DataFrame:
    """(query_id, pos, score, rank): the best top_k chunks by BM25, ties by position.

    Queries go to the tasks in blocks of at most ``block``, with at most ``room``
    different terms (or one query). A task takes its chunks in place, as rows of
    a matrix of damped term counts, multiplies it by the block's weights and
    keeps top_k rows of each query, so only those are shuffled. Chunks without a
    shared term score 0.
    """
    spark = index.chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    k = o.top_k if top_k is None else top_k
    mean = index.corpus.first()["avgdl"] or 1.0

    def search(rows: list) -> DataFrame:
        terms = sorted({w["term"] for _, weights in rows for w in weights})
        place = {t: j for j, t in enumerate(terms)}
        table = np.zeros((len(terms), len(rows)))
        for q, (_, weights) in enumerate(rows):
            for w in weights:
                table[place[w["term"]], q] = w["w"]
        held = spark.sparkContext.broadcast(([r[0] for r in rows], terms, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, weights = held.value
            known = pa.array(names, pa.string())
            best = _Best(len(ids), k, latest_first)
            rows_at_once = max(16, min(4096, (1 << 22) // max(1, len(names))))
            for whole in batches:
                for at in range(0, whole.num_rows, rows_at_once):
                    b = whole.slice(at, rows_at_once)
                    met = pc.index_in(b.column(2).flatten(), value_set=known).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
                    here = ~np.isnan(met) if met.dtype.kind == "f" else np.ones(len(met), bool)
                    row, col = row[here], met[here].astype(np.int64)
                    tf, dl = b.column(3).flatten().to_numpy()[here].astype(np.float64), b.column(1).to_numpy()[row]
                    counts = np.zeros((b.num_rows, len(names)))
                    counts[row, col] = tf * (o.k1 + 1) / (tf + o.k1 * (1 - o.b + o.b * dl / mean))
                    best.offer((counts @ weights).T, b.column(0).to_numpy())
            yield from best.rows(ids)

        return index.postings.select("pos", "dl", "terms", "tfs").mapInArrow(run, f"query_id {kind}, pos long, score double")

    done: list[DataFrame] = []
    part: list = []
    seen: set[str] = set()
    for query_id, weights in _weighted(index, queries).toLocalIterator():
        mine = {w["term"] for w in weights or []}
        if part and (len(part) == block or len(seen | mine) > room):
            done.append(staged(search(part), "hits"))
            part, seen = [], set()
        part.append((query_id, weights or []))
        seen |= mine
    if part:
        done.append(search(part))
    return _best_hits(done, spark, kind, k, latest_first)


def fused_ranks(semantic_hits: DataFrame, lexical_hits: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, pos, score, ord): reciprocal ranks summed; ``ord`` is the order of first mention."""
    part = lambda df, offset, first: df.select(
        "query_id", "pos", (F.lit(1.0) / (F.col("rank") - 1 + offset)).alias("s"), F.struct(F.lit(first).alias("a"), F.col("rank").alias("b")).alias("w")
    )
    both = part(semantic_hits, o.semantic_offset, 0).unionByName(part(lexical_hits, o.lexical_offset, 1))
    fused = both.groupBy("query_id", "pos").agg(F.sum("s").alias("score"), F.min("w").alias("w"))
    fused = fused.where(F.col("score") >= o.ensemble_threshold)
    return fused.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("w"))).drop("w")


def combined(semantic_hits: DataFrame, lexical_hits: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, pos, score, ord): both scores brought to 0..1 within the query, then weighted."""
    s = semantic_hits.select("query_id", "pos", F.col("score").alias("s"), F.col("rank").alias("sr"))
    x = lexical_hits.select("query_id", "pos", F.col("score").alias("l"), F.col("rank").alias("lr"))
    both = s.join(x, ["query_id", "pos"], "full").select(
        "query_id", "pos", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("l", F.lit(0.0)).alias("l"), "sr", "lr"
    )
    mine = Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        high, low = F.max(c).over(mine), F.min(c).over(mine)
        top = F.when(high > 0, high).otherwise(F.lit(1.0))
        return (F.col(c) - low) / F.when(top > low, top - low).otherwise(F.lit(1.0))

    order = Window.partitionBy("query_id").orderBy(F.col("sr").asc_nulls_last(), F.col("lr"))
    return both.select(
        "query_id",
        "pos",
        (scaled("s") * o.semantic_weight + scaled("l") * o.lexical_weight).alias("score"),
        F.row_number().over(order).alias("ord"),
    )


def rerank_factor(query: Column, text: Column, start_idx: Column) -> Column:
    """Boost for shared words and early chunks, penalty for very short and long ones."""
    q, n = F.array_distinct(lexical_tokens(query)), F.size(words(text))
    shared = F.size(F.array_intersect(q, F.array_distinct(lexical_tokens(text))))
    density = F.when(F.size(q) > 0, shared / F.size(q)).otherwise(F.lit(0.0))
    length = F.when(n < 10, F.lit(0.7)).when(n > 200, F.lit(0.8)).otherwise(F.lit(1.0))
    return (1 + density * 0.2) * length * F.when(F.coalesce(start_idx, F.lit(0)) < 1000, F.lit(1.1)).otherwise(F.lit(1.0))


def reranked(scored: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """``scored`` (query_id, pos, score, ord) with text, its score times the factor."""
    full = scored.join(index.chunks, "pos").join(queries, "query_id")
    factor = rerank_factor(F.col("query"), F.col("text"), F.col("start_idx"))
    return full.withColumn("score", F.col("score") * factor)


def _result(df: DataFrame, strategy: str) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", F.col("text").alias("content"), "score", F.lit(strategy).alias("strategy"))


def hybrid(index: Index, queries: DataFrame, o: SearchOptions = SearchOptions(), candidates: int = 20) -> DataFrame:
    scored = combined(semantic(index, queries, o, candidates), lexical(index, queries, o, candidates), o)
    return _top(reranked(scored, index, queries.select("query_id", "query")), o.top_k, F.round("score", 9).desc(), F.asc("ord"))


def ensemble(index: Index, queries: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """Rank fusion, then overlapping results merged; (query_id, rank, chunk_id, content, score)."""
    fused = fused_ranks(semantic(index, queries, o, 3 * o.top_k), lexical(index, queries, o, 3 * o.top_k), o)
    full = fused.join(index.chunks.select("pos", "text"), "pos")
    return merged_results(full.select("query_id", "ord", F.col("text").alias("content"), "score"), o.top_k)


def search(index: Index, queries: DataFrame, strategy: str = "ensemble", o: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, rank, chunk_id, content, score, strategy) of every query of (query_id, query).

    Any strategy but semantic, lexical and ensemble is hybrid, whose scores are reported as 1.
    """
    if index is None or index.chunks is None:
        raise ValueError("no index has been built")
    if strategy == "ensemble":
        return ensemble(index, queries, o).withColumn("strategy", F.lit("ensemble"))
    if strategy in ("semantic", "lexical"):
        hits = semantic(index, queries, o) if strategy == "semantic" else lexical(index, queries, o)
        return _result(hits.join(index.chunks, "pos"), strategy)
    return _result(hybrid(index, queries, o).withColumn("score", F.lit(1.0)), "hybrid")


def strategies(spark) -> DataFrame:
    """The strategies on offer and what runs them."""
    rows = [(n, "hybrid" if n == "ensemble_parallel" else n, n == "ensemble") for n in STRATEGIES]
    return spark.createDataFrame(rows, "name string, runs_as string, is_default boolean")
