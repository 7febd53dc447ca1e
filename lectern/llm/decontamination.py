"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles. In a partition of
items of up to u shingles an item's sketch is its floor(0.2 u) + 1 smallest
shingle hashes; a document is looked through whole, every shingle hash of it
against the sketches. A document that holds 0.8 of an item's n shingles lacks
at most 0.2 n of them, so it meets all but floor(0.2 n) of the sketch: at least
one hash, and about half of the sketch for the smallest items of a partition.
That bound is certain, whatever the document's length and wherever in it the
shingles lie, so no item is missed; what meets it is verified by exact
containment of the item's shingles in the whole document.

Words are lower-cased runs without white space and ASCII punctuation. Defined
results: an item with fewer than five words is one shingle of all its words; an
item without words matches nothing, as does a null or empty text. Shingles that
an item or a document repeats count once. Repeated documents and repeated items
each match. Empty tables give empty results. Ids may be null and are passed
through; other columns are ignored, except by ``drop_contaminated``, which
returns them as they are. The items are read in blocks of a bounded number of
shingles; each block is broadcast and meets all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import python_workers_see_library, stage

_DROPPED = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_DROPPED).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``width`` words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return mixed_runs(w, width)


def mixed_runs(w: np.ndarray, width: int) -> np.ndarray:
    n = len(w) - width + 1
    h = w[:n].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B185EBCA87)
        h += w[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Block:
    """Items of one broadcast: their shingles, and for each shingle width the (hash, item) pairs of all sketches."""

    threshold: float
    ids: list = field(default_factory=list)
    shingles: list[list[bytes]] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)  # sketch hashes that a document must meet
    sketches: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    size: int = 0

    def add(self, item_id, words: list[bytes], width: int) -> None:
        width = min(width, len(words))
        runs = {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}
        upper = 1 << max(3, (len(runs) - 1).bit_length())
        lacks = lambda n: math.floor((1 - self.threshold) * n + 1e-9)
        sketch = np.unique(shingle_hashes(words, width))[: lacks(upper) + 1].tolist()
        at = len(self.ids)
        self.ids.append(item_id)
        self.shingles.append(sorted(runs))
        self.needed.append(max(1, len(sketch) - lacks(len(runs))))
        self.sketches.setdefault(width, []).extend((h, at) for h in sketch)
        self.size += len(runs)


def item_blocks(items: DataFrame, width: int, threshold: float, max_shingles: int) -> Iterator[Block]:
    """Blocks of at most ``max_shingles`` shingles (or one item), read partition by partition."""
    block = Block(threshold)
    for r in items.select("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if not words:
            continue
        if block.size and block.size + len(words) > max_shingles:
            yield block
            block = Block(threshold)
        block.add(r["item_id"], words, width)
    if block.ids:
        yield block


class Searcher:
    """Finds a block's items in batches of documents."""

    def __init__(self, block: Block):
        self.block, self.threshold = block, block.threshold
        self.needles = [[b" " + s + b" " for s in x] for x in block.shingles]
        self.needed = np.array(block.needed)
        self.tables = {}
        for width, pairs in block.sketches.items():
            h, item = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            bits = max(16, min(26, (len(keys) * 64).bit_length()))
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[(keys >> shift).astype(np.int64)] = True
            self.tables[width] = (seen, shift, keys, first, count, item[order])

    def candidates(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs, in order, that meet as many sketch hashes as containment needs."""
        lengths = np.array([len(w) for w in texts], np.int64)
        flat = np.fromiter(map(xxhash.xxh64_intdigest, (x for w in texts for x in w)), np.uint64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        met = [np.empty((2, 0), np.int64)]
        for width, (seen, shift, keys, first, count, items) in self.tables.items():
            if len(flat) < width:
                continue
            runs = mixed_runs(flat, width)
            at = np.flatnonzero(seen[(runs >> shift).astype(np.int64)])
            doc = np.searchsorted(ends, at, "right")
            key = np.minimum(np.searchsorted(keys, runs[at]), len(keys) - 1)
            real = (at + width <= ends[doc]) & (keys[key] == runs[at])  # within one document, and in a sketch
            pairs = np.unique(doc[real] * len(keys) + key[real])  # a document's repeats count once
            doc, key = pairs // len(keys), pairs % len(keys)
            n = count[key]
            place = np.repeat(first[key], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            met.append(np.stack([np.repeat(doc, n), items[place]]))
        doc, item = np.concatenate(met, axis=1)
        pairs, hits = np.unique(doc * len(self.needed) + item, return_counts=True)
        doc, item = pairs // len(self.needed), pairs % len(self.needed)
        near = hits >= self.needed[item]
        return doc[near], item[near]

    def found(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of each verified pair, in order."""
        last, whole = -1, b""
        for d, i in zip(*(x.tolist() for x in self.candidates(texts))):
            if d != last:
                last, whole = d, b" " + b" ".join(texts[d]) + b" "
            needles = self.needles[i]
            shared = sum(x in whole for x in needles)
            if shared >= self.threshold * len(needles) - 1e-9:
                yield d, i, shared


_SEARCHERS: dict[int, Searcher] = {}


def _searcher(held) -> Searcher:
    """One searcher for a broadcast and worker; the last one only is kept."""
    if held.value is not _SEARCHERS.get("of"):
        _SEARCHERS.clear()
        _SEARCHERS.update({"of": held.value, "is": Searcher(held.value)})
    return _SEARCHERS["is"]


def _portions(texts: list[str | None], words: int = 400_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of documents with about so many words, to bound the arrays made from them."""
    part, size, first = [], 0, 0
    for k, t in enumerate(texts):
        part.append(words_of(t))
        size += len(part[-1])
        if size >= words:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, max_shingles: int = 500_000
) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment: each item in each document."""
    spark = docs.sparkSession
    python_workers_see_library(spark)
    slim = docs.select("doc_id", "text")
    item_type = items.schema["item_id"].dataType
    out = T.StructType(
        [
            T.StructField("doc_id", slim.schema["doc_id"].dataType),
            T.StructField("item_id", item_type),
            T.StructField("shared", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )

    def search(block: Block) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _searcher(held)
            for b in batches:
                ids = b.column(0)
                for first, part in _portions(b.column(1).to_pylist()):
                    pairs = list(s.found(part))
                    if pairs:
                        n = [len(s.needles[i]) for _, i, _ in pairs]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array([first + d for d, _, _ in pairs], pa.int64())),
                                pa.array([s.block.ids[i] for _, i, _ in pairs], type_of),
                                pa.array([x for _, _, x in pairs], pa.int64()),
                                pa.array(n, pa.int64()),
                                pa.array([x / m for (_, _, x), m in zip(pairs, n)], pa.float64()),
                            ],
                            names=out.names,
                        )

        return slim.mapInArrow(run, out)

    from pyspark.sql.pandas.types import to_arrow_type

    type_of = to_arrow_type(item_type)
    done: list[DataFrame] = []
    last = None
    for block in item_blocks(items, width, threshold, max_shingles):
        if last is not None:
            done.append(stage(last, "pairs"))  # a block's broadcast needn't outlive its pass
        last = search(block)
    if last is None:
        return spark.createDataFrame([], out)
    for part in done:
        last = last.unionByName(part)
    return last


def drop_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, max_shingles: int = 500_000
) -> DataFrame:
    """The rows that contain no item, with all their columns; no shuffle."""
    spark = docs.sparkSession
    python_workers_see_library(spark)
    at = docs.columns.index("text")

    def without(df: DataFrame, block: Block) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _searcher(held)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, part in _portions(b.column(at).to_pylist()):
                    keep[[first + d for d, _, _ in s.found(part)]] = False
                yield b.filter(pa.array(keep))

        return df.mapInArrow(run, docs.schema)

    for block in item_blocks(items, width, threshold, max_shingles):
        docs = without(docs, block)
    return docs
