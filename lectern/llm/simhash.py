"""SimHash near-duplicate classes over a Gray-order hierarchical index.

``fingerprints`` makes 64-bit SimHashes. ``links`` joins distinct fingerprints
that differ in at most ``radius`` bits. The top of the index are shared masked
patterns: with radius r, two linked codes agree on one of r + 1 bit blocks
whole, so a code is filed under its r + 1 block patterns, and no other pair has
to be looked at. Under a pattern the codes are sorted by Gray rank; runs of
neighbours share a parent whose mask holds the bits they agree on, parents
share further parents, and a search adds up differences from the top down and
prunes a whole group as soon as they exceed the radius (:class:`GrayIndex`).
A pattern that too many codes share is filed again under the rest of its bits.
A task returns a spanning star for each class it finds, never all pairs;
``components`` joins the stars across tasks by alternating large and small stars.

``near_duplicates`` is the variant for word shingles and a similarity bound:
texts are filed under their smallest shingle hashes instead of bit blocks, the
same index prunes by fingerprint, and pairs are verified by exact Jaccard
similarity of their shingle sets.

Defined results: a null or empty text has fingerprint 0 and is linked like any
other. Rows with a null id take part; a class whose ids are all null has a null
component. Repeated rows fall into one class. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import discard, python_workers_see_library, spread_join, stage

SEED = 42


def shingles_of(text: str | None, width: int) -> list[bytes]:
    """Shingles with repeats; the whole sequence if there are fewer words, none if there are none."""
    w = (text or "").encode().lower().split()  # on bytes, only A-Z are lowered and only the six separators split
    if len(w) < width:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*[w[k:] for k in range(width)])]


def hashes_of(text: str | None, width: int) -> np.ndarray:
    s = shingles_of(text, width)
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in s], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit integer."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def _portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in small slices, so that few texts are Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fingerprint ``fp`` of every whole text."""
    python_workers_see_library(docs.sparkSession)
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            fp = [simhash(hashes_of(t, width)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("fp", T.LongType())]))


def gray_rank(code: Column) -> Column:
    """Position of a code in the reflected Gray sequence (its inverse Gray code)."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


class GrayIndex:
    """Forest of codes that come sorted by (group, Gray rank): a tree for each group.

    A node's mask holds the bits on which its codes agree beyond its parent's
    mask, its pattern their values there.
    """

    FANOUT = 8

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        own = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(codes))))
        self.tree = own
        nodes = np.arange(len(codes))
        all_, any_ = codes, codes
        self.levels: list[tuple] = []  # (and, or, first child, number of children, last leaf), leaves first
        first, count, last, tree = nodes, np.zeros(len(codes), np.int64), nodes, own
        self.levels.append((all_, any_, first, count, last))
        while len(tree) > len(edge):
            start = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            size = np.diff(np.append(start, len(tree)))
            place = np.arange(len(tree)) - np.repeat(start, size)
            head = np.flatnonzero(place % self.FANOUT == 0)
            count = np.diff(np.append(head, len(tree)))
            all_ = np.bitwise_and.reduceat(all_, head)
            any_ = np.bitwise_or.reduceat(any_, head)
            last = last[head + count - 1]
            tree = tree[head]
            self.levels.append((all_, any_, head, count, last))

    def pairs(self, radius: int, room: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of codes of a group within ``radius``; i comes in blocks, in order."""
        sizes = np.bincount(self.tree)
        reach = sizes[self.tree]
        queries = np.flatnonzero(reach > 1)
        if not len(queries):
            return
        cuts = np.cumsum(np.minimum(reach[queries], room))
        for k in range(int(cuts[-1] // room) + 1):
            part = queries[(cuts // room) == k]
            if len(part):
                yield from self._search(part, radius)

    def _search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        q, node = queries, self.tree[queries]
        seen = np.zeros(len(q), np.uint64)
        diff = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            all_, any_, first, count, last = self.levels[depth]
            agreed = ~(all_[node] ^ any_[node])
            code = self.codes[q]
            diff = diff + np.bitwise_count((code ^ all_[node]) & agreed & ~seen)
            stay = (diff <= radius) & (last[node] > q)
            q, node, diff, seen = q[stay], node[stay], diff[stay], agreed[stay]
            if not len(q):
                return
            if depth:
                n = count[node]
                start = np.repeat(first[node], n)
                step = np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                q, diff, seen, node = np.repeat(q, n), np.repeat(diff, n), np.repeat(seen, n), start + step
        yield q, node


def stars(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest position reachable from each of n positions over links (a, b)."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        low = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str = "k") -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from a stream that is sorted by them."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut == 0 and rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = [b]
        elif cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = [b.slice(cut)]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)


def _block_masks(bits: list[int], parts: int) -> list[int]:
    """``bits`` dealt into ``parts`` masks, as signed 64-bit integers."""
    out = []
    for k in range(parts):
        m = sum(1 << b for b in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts])
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _filed(codes: DataFrame, radius: int, room: int) -> DataFrame:
    """(k, fp): codes under the keys of their masked patterns; at most ``room`` under a key while bits are left."""
    masks = [(m,) for m in _block_masks(list(range(64)), radius + 1)]
    filed = codes.select("fp", F.explode(F.array(*[F.lit(m[0]) for m in masks])).alias("mask"))
    done: DataFrame | None = None
    for _ in range(4):
        filed = filed.withColumn("k", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        crowded = filed.groupBy("k", "mask").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > room)
        crowds = crowded.select("k", "mask")
        held = [r["mask"] for r in crowds.select("mask").distinct().collect()]  # masks, a few of them
        if not held:
            break
        crowds = stage(crowds, "crowds")
        calm = filed.join(crowds, ["k", "mask"], "left_anti").select("k", "fp")
        done = calm if done is None else done.unionByName(calm)
        finer: Column | None = None
        for m in held:
            left = [b for b in range(64) if not (m >> b) & 1]
            if len(left) <= radius + 1:
                continue
            more = F.array(*[F.lit(m | x) for x in _block_masks(left, radius + 1)])
            finer = F.when(F.col("mask") == F.lit(m), more) if finer is None else finer.when(F.col("mask") == F.lit(m), more)
        finer = F.array("mask") if finer is None else finer.otherwise(F.array("mask"))
        filed = filed.join(crowds, ["k", "mask"]).select("fp", F.explode(finer).alias("mask"))
        filed = stage(filed, "filed")
    last = filed.withColumn("k", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))).select("k", "fp")
    return last if done is None else done.unionByName(last)


def links(codes: DataFrame, radius: int = 2, room: int = 50_000) -> DataFrame:
    """Spanning links (a, b), a > b, of the classes of distinct codes ``fp`` within ``radius``."""
    filed = _filed(codes, radius, room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            keys, code = t.column("k").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            label = np.arange(len(code))
            for i, j in GrayIndex(code, keys).pairs(radius):
                label = stars(len(code), i, j, label)
            far = np.flatnonzero(label != np.arange(len(code)))
            a, b = code[far].view(np.int64), code[label[far]].view(np.int64)
            apart = a != b
            a, b = a[apart], b[apart]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    sorted_ = filed.repartition("k").sortWithinPartitions("k", gray_rank(F.col("fp")))
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is staged, and the
    minima are partial aggregates, so a hub's links are never one task's list.
    """

    def swapped(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        both = swapped(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        down = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return down.unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))

    edges = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        last, edges = edges, stage(small(large(edges).distinct()).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    marked = stage(fingerprints(docs, width), "fingerprints")
    codes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "codes")
    root = stage(components(links(codes.select("fp"), radius)), "roots")
    linked = codes.join(root, codes["fp"] == root["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = linked.join(least, "root").select("fp", "component")
    own = F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least"))
    named = stage(codes.join(joined, "fp", "left").select("fp", "n", own.alias("component_id")), "named")
    return spread_join(marked, named, "fp", "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Random keys of the permutations of a text's signature; the first of them are also its routes.
_TURNS = np.array([xxhash.xxh64_intdigest(b"turn %d" % k, SEED) for k in range(64)], np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """Smallest shingle hash under each permutation: a key of its own, then splitmix64's finaliser, so that minima are independent."""
    low = np.full(len(_TURNS), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):
        x = h[at : at + 512, None] ^ _TURNS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        low = np.minimum(low, x.min(0))
    return low


def _sketched(texts: DataFrame, width: int, routes: int) -> DataFrame:
    """row, doc_id, key of the text, fp of and number of distinct shingles, ``routes`` smallest hashes, and a byte of all 64."""
    slim = texts.select("row", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("t"), "text")
    more = [("fp", T.LongType()), ("n", T.LongType()), ("low", T.ArrayType(T.LongType())), ("sig", T.BinaryType())]
    out = T.StructType([*slim.schema.fields[:3], *[T.StructField(*x) for x in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            fp, n, low, sig = [], [], [], []
            for t in b.column(3).to_pylist():
                h = np.unique(hashes_of(t, width))  # similarity is of sets, so repeats must not weigh
                fp.append(simhash(h))
                n.append(len(h))
                least = signature(h)
                low.append(least[:routes].view(np.int64).tolist() if len(h) else [])
                sig.append(least.astype(np.uint8).tobytes())
            made = [pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=out.names)

    return slim.mapInArrow(run, out)


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """row and its sorted distinct shingle hashes as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            sets = [np.unique(hashes_of(t, width)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["row", "set"])

    return texts.select("row", "text").mapInArrow(run, "row long, set binary")


def _suspects(sketches: DataFrame, min_similarity: float, radius: int, room: int) -> DataFrame:
    """(k, fp, row): rows under the keys where they have a partner of like size within the radius.

    A partner must also share half of the 64 signature bytes at least: pairs of
    similarity 0.8 share 51.2 on average, with a deviation of 3.2 as the permutations
    are independent, so half is six deviations off. A pair counts only under the first of the smallest hashes that both share,
    so a row is carried on for few of its keys.
    """
    filed = sketches.select("row", "fp", "n", "low", "sig", F.posexplode("low").alias("j", "v")).withColumn("k", F.xxhash64("j", "v"))
    counts = filed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    filed = filed.join(counts, "k")
    # A crowded key is split exactly: its rows are dealt into blocks of half the room, and every two blocks meet under a key of their own.
    filed = filed.withColumn("blocks", F.ceil(F.col("c") / F.lit(max(room // 2, 1))))
    filed = filed.withColumn("block", F.pmod(F.xxhash64("row", F.lit(SEED)), "blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: q != F.col("block"))
    met = F.transform(others, lambda q: F.xxhash64("k", F.least("block", q), F.greatest("block", q)))
    finer = F.when(F.col("c") > room, met).otherwise(F.array("k"))
    filed = filed.select("row", "fp", "n", "low", "sig", "j", F.explode(finer).alias("k"))
    slim = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "fp", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            keys, code, n, route = (t.column(c).to_numpy() for c in ("k", "fp", "n", "j"))
            low = t.column("low").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
            least = min_similarity * 0.625 * sig.shape[1]
            near = np.zeros(len(code), bool)
            for i, j in GrayIndex(code.view(np.uint64), keys).pairs(radius):
                fits = np.minimum(n[i], n[j]) >= min_similarity * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                for k in range(low.shape[1] - 1):
                    first = (route[i] <= k) | (low[i, k] != low[j, k])
                    i, j = i[first], j[first]
                like = np.concatenate([(sig[i[k : k + 65536]] == sig[j[k : k + 65536]]).sum(1) >= least for k in range(0, len(i), 65536)] or [[]])
                i, j = i[like.astype(bool)], j[like.astype(bool)]
                near[i] = near[j] = True
            at = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(at)) for c in slim.names], names=slim.names)
        pa.default_memory_pool().release_unused()

    return filed.repartition("k").sortWithinPartitions("k", gray_rank(F.col("fp"))).mapInArrow(run, slim)


def _packed(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The packed 64-bit integers of each binary value, without a copy."""
    held = column.combine_chunks()
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int32)[held.offset : held.offset + len(held) + 1] // 8
    values = np.frombuffer(data, np.uint64) if data is not None and data.size else np.empty(0, np.uint64)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _verified_links(near: DataFrame, sets: DataFrame, min_similarity: float, radius: int) -> DataFrame:
    """Spanning links (a, b) between suspect rows of similar shingle sets (row, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            keys, code, row = (t.column(c).to_numpy() for c in ("k", "fp", "row"))
            sets = _packed(t.column("set"))
            size = np.array([len(x) for x in sets])
            label = np.arange(len(row))
            for i, j in GrayIndex(code.view(np.uint64), keys).pairs(radius):
                fits = np.minimum(size[i], size[j]) >= min_similarity * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else []
                for x, y in zip(heads, [*heads[1:], len(i)]):
                    label = _verify(int(i[x]), j[x:y], sets, size, label, min_similarity)
            far = np.flatnonzero(label != np.arange(len(row)))
            a, b = row[far], row[label[far]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        pa.default_memory_pool().release_unused()

    full = near.join(sets, "row").select("k", "fp", "row", "set")
    full = full.repartition("k").sortWithinPartitions("k", gray_rank(F.col("fp")))
    return full.mapInArrow(run, "a long, b long").distinct()


def _verify(i: int, js: np.ndarray, sets: list, size: np.ndarray, label: np.ndarray, bound: float) -> np.ndarray:
    """Labels after position i has met those of ``js`` that aren't in its class yet."""
    while True:
        js = js[label[js] != label[i]]
        if not len(js):
            return label
        part, js = js[:256], js[256:]
        joined = np.concatenate([sets[j] for j in part])
        mine = sets[i]
        at = np.searchsorted(mine, joined)
        at[at == len(mine)] = 0
        hit = mine[at] == joined
        start = np.concatenate([[0], np.cumsum(size[part])[:-1]])
        both = np.add.reduceat(hit.astype(np.int64), start)
        like = both >= bound * (size[i] + size[part] - both) - 1e-9
        for j in part[like]:
            x, y = label[i], label[j]
            if x != y:
                label[label == max(x, y)] = min(x, y)


def near_duplicates(
    docs: DataFrame, width: int = 5, min_similarity: float = 0.8, radius: int = 24, routes: int = 8, room: int = 4000
) -> DataFrame:
    """One row of each class, with all columns: the one with the smallest id (null ids last).

    The radius lies five deviations above the 9.7 bits that fingerprints of
    sets of similarity 0.8 differ in on average.

    Equal texts are one class before anything else; texts without words are
    equal to each other only if they are the same text.
    """
    spark = docs.sparkSession
    python_workers_see_library(spark)
    cols = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.monotonically_increasing_id().alias("row"))
    whole = stage(whole, "numbered")
    texts = whole.select("row", F.col("_row")["doc_id"].alias("doc_id"), F.col("_row")["text"].alias("text"))
    sketches = stage(_sketched(texts, width, routes), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), "row")).alias("m")
    groups = sketches.groupBy("t").agg(first, F.first(F.struct("fp", "n", "low", "sig")).alias("s"))
    reps = stage(groups.select("m.x", "m.d", "m.row", "s.fp", "s.n", "s.low", "s.sig"), "distinct")
    near = stage(_suspects(reps, min_similarity, radius, room), "near")
    # The only exchange of whole rows; suspects' shingles and the result are both read from it.
    moved = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").persist(StorageLevel.DISK_ONLY)
    suspects = moved.join(near.select("row").distinct(), "row", "left_semi")
    sets = _shingle_sets(suspects.select("row", F.col("_row")["text"].alias("text")), width)
    edges = stage(_verified_links(near, sets, min_similarity, radius), "links")
    root = components(edges)
    placed = reps.join(root, reps["row"] == root["node"], "left").select("row", "x", "d", F.coalesce("root", "row").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct("x", "d", "row")).alias("m")).select(F.col("m")["row"].alias("row"))
    kept = moved.join(best, "row", "left_semi")
    result = stage(kept.select(*[F.col("_row")[c].alias(c) for c in cols]), "kept")
    moved.unpersist()
    discard(whole, sketches, reps, near, edges)
    return result
