"""Chunkers: sentences, paragraphs, word windows; all folds over arrays of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import let, strip, words
from lectern.options import ChunkOptions

CHUNK = "struct<text:string,start_idx:int,end_idx:int,chunk_type:string,num_sentences:int,num_paragraphs:int,resized:boolean>"


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.!?]+", -1), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n", -1), strip), lambda x: x != "")


def _chunk(text: Column, start: Column, end: Column, kind: str, n_sentences=None, n_paragraphs=None) -> Column:
    parts = [
        text.alias("text"),
        start.cast("int").alias("start_idx"),
        end.cast("int").alias("end_idx"),
        F.lit(kind).alias("chunk_type"),
        (F.lit(None) if n_sentences is None else n_sentences).cast("int").alias("num_sentences"),
        (F.lit(None) if n_paragraphs is None else n_paragraphs).cast("int").alias("num_paragraphs"),
        F.lit(False).alias("resized"),
    ]
    return F.struct(*parts).cast(CHUNK)


def _packed(pieces: Column, limit: float, emit, carried, advance) -> Column:
    """Pieces packed in order: a chunk is emitted when the next piece would exceed ``limit`` words.

    The state is the open pieces with their sizes, where they start, and the
    chunks so far. ``carried``: open pieces that the next chunk repeats;
    ``advance``: how far the start moves.
    """
    piece = "array<struct<t:string,n:int>>"
    sized = F.transform(pieces, lambda t: F.struct(t.alias("t"), F.size(words(t)).alias("n")))
    start = F.struct(
        F.array().cast(piece).alias("open"), F.lit(0).alias("size"), F.lit(0).alias("start"), F.array().cast(f"array<{CHUNK}>").alias("out")
    )

    def step(s: Column, x: Column) -> Column:
        full = (s["size"] + x["n"] > limit) & (F.size(s["open"]) > 0)
        kept = carried(s["open"])
        again = F.concat(kept, F.array(x))
        return F.when(
            full,
            F.struct(
                again.alias("open"),
                F.aggregate(again, F.lit(0), lambda a, y: a + y["n"]).alias("size"),
                (s["start"] + advance(kept, x)).cast("int").alias("start"),
                F.concat(s["out"], F.array(emit(s))).alias("out"),
            ),
        ).otherwise(
            F.struct(
                F.concat(s["open"], F.array(x)).alias("open"), (s["size"] + x["n"]).alias("size"), s["start"].alias("start"), s["out"].alias("out")
            )
        )

    close = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["out"], F.array(emit(s)))).otherwise(s["out"])
    return F.aggregate(sized, start, step, close)


def _joined(state: Column, mark: str) -> Column:
    return F.array_join(F.transform(state["open"], lambda y: y["t"]), mark)


def semantic_chunks(c: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """Whole sentences; a chunk repeats the last two of the one before."""
    emit = lambda s: _chunk(_joined(s, " "), s["start"], s["start"] + s["size"], "semantic", F.size(s["open"]))
    last_two = lambda a: F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2))
    return _packed(sentences(c), o.size, emit, last_two, lambda kept, x: F.size(kept) * 10)


def hierarchical_chunks(c: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """Whole paragraphs; the start moves by the size of the paragraph that opens the next chunk."""
    emit = lambda s: _chunk(_joined(s, "\n\n"), s["start"], s["start"] + s["size"], "hierarchical", None, F.size(s["open"]))
    return _packed(paragraphs(c), o.size * 1.5, emit, lambda a: F.slice(a, 1, 0), lambda kept, x: x["n"])


def fixed_chunks(c: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """Word windows of one size that overlap."""

    def windows(w: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(w, i + 1, F.lit(o.size))
            return _chunk(F.array_join(part, " "), i, F.least(i + o.size, F.size(w)), "fixed_size")

        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(o.size - o.overlap))
        return F.when(F.size(w) > 0, F.transform(starts, one)).otherwise(F.array().cast(f"array<{CHUNK}>"))

    return let(words(F.coalesce(c, F.lit(""))), windows)


def raw_chunks(c: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """Sentence and paragraph chunks; word windows too if there are fewer than three."""
    both = F.concat(semantic_chunks(c, o), hierarchical_chunks(c, o))
    return let(both, lambda a: F.when(F.size(a) < 3, F.concat(a, fixed_chunks(c, o))).otherwise(a))


def resized(chunks: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """Chunks over the size cut into consecutive pieces."""

    def cut(x: Column) -> Column:
        def pieces(w: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(o.size))
            fresh = lambda i: x.withField("text", F.array_join(F.slice(w, i + 1, F.lit(o.size)), " ")).withField("resized", F.lit(True))
            return F.when(F.size(w) > o.size, F.transform(starts, fresh)).otherwise(F.array(x))

        return let(words(x["text"]), pieces)

    return F.flatten(F.transform(chunks, cut))


def exploded(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """``keep`` columns, chunk_pos and the fields of each chunk."""
    return docs.select(*keep, F.posexplode(chunks).alias("chunk_pos", "c")).select(*keep, "chunk_pos", "c.*")
