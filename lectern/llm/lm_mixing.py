"""Language-model scoring by online logistic context mixing.

The model gives the probability of a text, its words spelled byte by byte in
their order, with a blank after each word and a line end after the last. A byte
is a walk down a Huffman tree, the tree of the bytes that follow the byte before it
in the training texts (a blank before the first); each turn is a bit that three predictors judge, each from its own hashed context: the last three bytes
and the last five bytes of the text, across blanks, and the word so far together
with the whole word before it. A predictor is a table of a fixed size that holds
how often each turn was taken in a context, over all training texts. The
predictors' log-odds are combined by weights that a gate picks (how much the two
longer contexts have been seen), and a map by the mixture's own size corrects
the sum. Weights and map begin the same in every text and are learned online
along it, in the order of its bytes: a stretch of the text is judged with what
the stretches before it taught, then it teaches in turn. Stretches end after 64,
128, 256 and so on up to 4,096 bytes, then after every 4,096.

So a score depends on the training counts and the text alone: not on how rows
are dealt into tasks, nor on which texts are scored beside it.

What is gathered from the corpus grows with it: words are counted over all
documents, training and held out apart, into a staged table for the base model;
the ``head`` most frequent words go to the tasks, all others are met by a join.
Bit counts are taken from every training text.

Defined results: a null or empty text is the end token alone. A null id counts
as an empty text for the split. Repeated rows are learned and scored each time.
Without training documents all counts are 0 and every bit is even. Words of any
length and texts of any length are spelled out whole. Only doc_id and text are
read; other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import discard, python_workers_see_library, stage

#: Bits of each predictor's table: contexts of 3 and 5 bytes, and the word so far after the word before.
TABLE_BITS = (19, 21, 21)
_U = np.uint32
_MIX = tuple(_U(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))
_BASE = _U(0x01000193)
_GATES = 16  # four degrees of use of each of the last two contexts
_STEPS = 24  # buckets of the map, over log-odds from -12 to 12
_EVEN = 0.05  # added to the counts of both turns
_REACH, _FINE = 10, 800  # log-odds are held up to this size, in so many steps a unit
_START, _RATE, _CALM = 0.4, 0.1, 20  # first weight, pace of learning, bits that a map's bucket waits for
_FIRST, _LONGEST = 64, 4096  # bytes of a text's first stretch and of its longest ones
_HEAD_BYTES = 64  # longer words are met by the join, so that the head's size is bounded
_LANES = 4  # sums are taken in so many lanes, so that neighbours of one cell needn't wait for one another
_BLOCK = 2048  # table slots that travel together


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; :func:`_words` has them for many texts at once."""
    return (text or "").encode().lower().split()


def _words(texts: pa.Array) -> pa.ListArray:
    """Each text's words; a text without any has an empty one."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))


def _tokens(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, then an end token (the empty word) for each text; for every one of them its text."""
    flat, owner = words.flatten().cast(pa.binary()), pc.list_parent_indices(words).to_numpy()
    some = pc.not_equal(flat, b"")
    if not pc.all(some).as_py():
        flat, owner = flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    ended = pa.concat_arrays([flat, pa.repeat(pa.scalar(b"", pa.binary()), len(words))])
    return ended, np.concatenate([owner, np.arange(len(words))])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that few texts are Python's at once; Arrow gives back what it holds beside the last batch."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame, room: int = 1 << 24) -> DataFrame:
    """(word, c, held): counts in training and held-out documents; the end token is the empty word.

    Tasks count ``room`` bytes of text before anything is sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[list, list] = ([], [])
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(seen):
                words, values = pa.chunked_array(parts, pa.binary()).value_counts().flatten()
                zero = pa.array(np.zeros(len(values), np.int64))
                pair = [zero, values] if k else [values, zero]
                yield pa.RecordBatch.from_arrays([words, *pair], names=["word", "c", "held"])
                parts.clear()

        for b in _pieces(batches):
            apart = np.fromiter(map(held_out, b.column(0).to_pylist()), bool, b.num_rows)
            for parts, mine in zip(seen, (~apart, apart)):
                words, _ = _tokens(_words(b.column(1).filter(pa.array(mine))))
                parts.append(words)
                size += words.nbytes
            if size >= room:
                yield from out()
                size = 0
        yield from out()
        pa.default_memory_pool().release_unused()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word binary, c long, held long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Length of each symbol's Huffman code; no code is longer than some thirty bits."""
    counts = np.maximum(counts, max(1, int(counts.sum()) >> 24))
    heap = [(int(c), k, (k,)) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    out = np.zeros(len(counts), np.int32)
    for serial in range(len(counts), 2 * len(counts) - 1):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        out[list(x + y)] += 1
        heapq.heappush(heap, (a + b, serial, x + y))
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with a one before their first bit, so that each beginning names a node of the tree."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    deepest = int(lengths.max())
    room = np.int64(1) << (deepest - lengths[order]).astype(np.int64)
    out = np.zeros(len(lengths), np.int64)
    out[order] = (np.cumsum(room) - room) >> (deepest - lengths[order])
    return (out | np.int64(1) << lengths).astype(np.uint32)


class Trees:
    """A tree for each byte that may stand before, looked up at 256 times that byte plus the byte itself.

    A byte's bits come in runs of four at most. A run has its bits behind a
    leading one, and a hash of the bits of its byte before it.
    """

    def __init__(self, pairs: np.ndarray):
        """From counts of (byte before, byte)."""
        lengths = [code_lengths(row) for row in pairs.reshape(256, 256)]
        codes = np.concatenate([codes_of(x) for x in lengths])
        self.lengths = np.concatenate(lengths)
        self.runs = (self.lengths + 3) >> 2
        self.first = np.cumsum(self.runs, dtype=np.int32) - self.runs
        nth = np.arange(int(self.runs.sum()), dtype=np.int32) - np.repeat(self.first, self.runs)
        left = np.repeat(self.lengths, self.runs) - 4 * nth  # bits of the byte from a run on
        code = np.repeat(codes, self.runs)
        self.before = (code >> left.astype(np.uint32)) * _MIX[0]
        size = np.minimum(left, 4)
        one = _U(1) << size.astype(np.uint32)
        self.own = (((code >> (left - size).astype(np.uint32)) & (one - _U(1))) | one).astype(np.uint8)
        self.own_first = self.own[self.first]


def _walks() -> np.ndarray:
    """For a run's bits behind a leading one: each bit behind those before it and a one; 0 where a run has no more bits."""
    out = np.zeros((32, 4), np.uint8)
    for own in range(2, 32):
        for k in range(own.bit_length() - 1):
            out[own, k] = own >> (own.bit_length() - 2 - k)
    return out.view(np.uint32).ravel()


_WALKS = _walks()


def spelled(words: list[bytes]) -> bytes:
    """The words in order, each with a blank after it; :func:`contexts_of` adds the line end."""
    return b"".join([w + b" " for w in words])


def _spelled(words: pa.ListArray) -> list[bytes]:
    """The same for each of many texts."""
    return [w + b" " if w else w for w in pc.binary_join(words, pa.scalar(" ", words.type.value_type)).cast(pa.binary()).to_pylist()]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[0]
    x ^= x >> _U(15)
    x *= _MIX[1]
    x ^= x >> _U(13)
    return x


def contexts_of(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every byte of the texts and the line end after each: the byte and 256 times the one before, its hashed contexts."""
    raw = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    n = len(raw)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    wide = raw.astype(np.uint32)

    def back(k: int) -> np.ndarray:
        """The byte k places before; 0 before a text begins."""
        out = np.zeros(n, np.uint32)
        out[k:] = wide[: max(n - k, 0)]
        for j in range(k):
            out[begin[sizes > j] + j] = 0
        return out

    near = back(1)
    pair = (near << _U(8)) | wide
    pair[begin] = raw[begin] | _U(32 << 8)
    near |= back(2) << _U(8)
    near |= back(3) << _U(16)
    far = (near | back(4) << _U(24)) * _MIX[2] + back(5) * _MIX[3]
    # A word ends with its blank or line end; its hash is a sum over its bytes, by their place in it.
    opens = np.zeros(n, bool)
    opens[begin] = True
    opens[1:] |= raw[:-1] == 32
    heads = np.flatnonzero(opens)
    lengths = np.diff(np.append(heads, n))
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(lengths.max()), _BASE)]), dtype=np.uint32)
    inside = np.arange(n, dtype=np.int32) - np.repeat(heads.astype(np.int32), lengths)
    rolled = np.zeros(n + 1, np.uint32)
    np.cumsum((wide + _U(1)) * power[inside], dtype=np.uint32, out=rolled[1:])  # wraps around, as a hash may
    whole = np.concatenate([[_U(0)], np.diff(rolled[np.append(heads, n)])[:-1]])
    whole[np.searchsorted(heads, begin)] = 0
    word = rolled[:-1] + np.repeat(_mixed(whole) - rolled[heads], lengths)
    contexts = [_mixed(x + salt) for x, salt in zip((near, far, word), _MIX)]
    return pair.astype(np.uint16), contexts


def runs_of(pair: np.ndarray, contexts: list[np.ndarray], trees: Trees) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every run of the bytes: its bits behind a leading one, and its place in each table.

    All bytes' first runs, then the few others in their order. A place has 16
    slots, one for each way that the bits of a run can begin: one place in
    memory to go to instead of four.
    """
    pair = pair.astype(np.intp)
    own = trees.own_first.take(pair)
    more = np.flatnonzero(trees.runs.take(pair) > 1)
    pair = pair.take(more)
    runs = trees.runs.take(pair) - 1
    byte = np.repeat(more, runs)
    run = np.repeat(trees.first.take(pair) + 1 - np.cumsum(runs, dtype=np.int32) + runs, runs)
    run += np.arange(len(run), dtype=np.int32)
    before = trees.before.take(run)
    places = []
    for c, bits in zip(contexts, TABLE_BITS):
        h = np.concatenate([c, c.take(byte)])
        h[: len(c)] += _MIX[0]  # no bits before, behind a one
        h[len(c) :] += before
        h ^= h >> _U(15)
        h *= _MIX[1]
        h >>= _U(36 - bits)
        places.append(h)
    return np.concatenate([own, trees.own.take(run)]), places


def _portions(texts: Iterator[bytes], most: int = 1 << 17) -> Iterator[list[bytes]]:
    """Runs of whole texts with about ``most`` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Portions of the training texts in (doc_id, text)."""

    def texts() -> Iterator[bytes]:
        for b in _pieces(batches):
            learned = [not held_out(x) for x in b.column(0).to_pylist()]
            yield from _spelled(_words(b.column(1).filter(pa.array(learned, pa.bool_()))))

    return _portions(texts(), 1 << 18)


def byte_pairs(words: DataFrame) -> np.ndarray:
    """How often each byte follows each other one (256 times that) in the training texts, spelled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16)
        for b in batches:
            ended = [b" " + w + b" " if w else b" \n" for w in b.column(0).to_numpy(zero_copy_only=False)]
            sizes = np.fromiter(map(len, ended), np.int64, len(ended))
            raw = np.frombuffer(b"".join(ended), np.uint8).astype(np.int64)
            each = np.repeat(b.column(1).to_numpy().astype(float), sizes)
            each[np.cumsum(sizes) - 1] = 0  # a word's last byte is followed by the next word's blank, which is its own
            total += np.bincount(raw * 256 + np.append(raw[1:], 0), each, 1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "c"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        out[r["pair"]] = r["c"]
    return out


def bit_counts(docs: DataFrame, trees: Trees, most: int = 1 << 32) -> DataFrame:
    """(t, block, counts): how often each turn was taken in each slot of each table, along all training texts.

    The tables have a fixed size; they travel in blocks, 64 tasks' parts summed
    first, one part in memory at a time. A task sends its tables before it has
    counted ``most`` bits, which is what they hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId() // 64, 0
        tables = [np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]

        def out() -> Iterator[pa.RecordBatch]:
            for k, t in enumerate(tables):
                _add_beginnings(t)
                blocks = t.reshape(-1, 2 * _BLOCK)
                for j in np.flatnonzero(blocks.any(axis=1)).tolist():
                    yield _block(k, j, part, blocks[j])
                t[:] = 0

        for texts in _learned(batches):
            pair, contexts = contexts_of(texts)
            for at in range(0, len(pair), 1 << 16):
                few = slice(at, at + (1 << 16))
                own, places = runs_of(pair[few], [c[few] for c in contexts], trees)
                if seen + len(own) >= most:
                    yield from out()
                    seen = 0
                seen += len(own)
                for t, s in zip(tables, places):
                    s <<= _U(5)
                    s |= own
                    np.add.at(t, s.astype(np.intp), _U(1))
        yield from out()

    parts = docs.mapInArrow(run, _BLOCKS)
    return _summed(_summed(parts).withColumn("part", F.lit(0).cast("long")))


def _add_beginnings(runs: np.ndarray) -> None:
    """From counts of whole runs at their place to counts of every turn in them, where they are.

    A run's bits behind a leading one are the place among 32 of its last turn;
    each turn before it has the place that is left without the bits behind.
    """
    by = runs.reshape(-1, 32)
    for v in range(15, 1, -1):
        by[:, v] += by[:, 2 * v] + by[:, 2 * v + 1]


_BLOCKS = "t long, block long, part long, counts binary"


def _block(t: int, block: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counts in the fewest bytes that hold them; the length tells how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(counts.max()) <= np.iinfo(k).max)
    arrays = [pa.array([t]), pa.array([block]), pa.array([part]), pa.array([counts.astype(kind).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["t", "block", "part", "counts"])


def _unpacked(packed: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(packed) // (2 * _BLOCK)]
    return np.frombuffer(packed, kind)


def _summed(parts: DataFrame) -> DataFrame:
    """Blocks of a group added up as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for *mine, packed in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if mine != key:
                    if key is not None:
                        yield _block(*key, total)
                    key, total = mine, np.zeros(2 * _BLOCK, np.int64)
                total += _unpacked(packed.as_py()).astype(np.int64)
        if key is not None:
            yield _block(*key, total)

    by = ["t", "block", "part"]
    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _BLOCKS)


def held_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds and degree of use of each slot, from pairs of counts, in 16 bits."""
    zero, one = counts.reshape(-1, 2).T.astype(np.float64)
    odds = np.clip(np.log((one + _EVEN) / (zero + _EVEN)), -_REACH, _REACH)
    n = zero + one
    degree = (n > 0).astype(np.int64) + (n > 2) + (n > 20)
    return (np.rint((odds + _REACH) * _FINE).astype(np.int64) * 4 + degree).astype(np.uint16)


@dataclass
class Model:
    trees: Trees
    tables: list[np.ndarray]

    @cached_property
    def places(self) -> list[np.ndarray]:
        """The tables by their places of 16 slots, each of which lies in one line of the cache."""
        out = []
        for t in self.tables:
            room = np.empty(t.nbytes + 64, np.uint8)
            at = -room.ctypes.data % 64
            room[at : at + t.nbytes] = t.view(np.uint8)
            out.append(room[at : at + t.nbytes].view("V32"))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each spelled text.

        The texts go side by side, stretch by stretch; each has its own weights
        and map, so none sees another.
        """
        pair, contexts = contexts_of(texts)
        owner, order, sizes, ends = _stretches(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        pair, contexts = pair.take(order), [c.take(order) for c in contexts]
        edges = np.cumsum(sizes) - sizes
        lengths = self.trees.lengths.take(pair)
        n_bits = np.add.reduceat(lengths, edges, dtype=np.int64)
        n_first = np.add.reduceat(np.minimum(lengths, 4), edges, dtype=np.int64)
        edges = [*edges.tolist(), len(pair)]
        n, k_all = len(texts), len(self.tables)
        cells = n * _STEPS  # of a text's, the first _GATES have weights
        weights = np.full((k_all, cells), _START, np.float32)
        pace = np.full((k_all, cells), 1e-4)
        bend = np.zeros(cells, np.float32)
        out = np.zeros(n)
        lanes = (np.arange(int(np.add.reduceat(n_bits, [0, *ends[:-1]]).max())) & (_LANES - 1)) * cells
        room = np.empty(0, "V32")
        for i, j in zip([0, *ends], ends):
            few = slice(edges[i], edges[j])
            own, places = runs_of(pair[few], [c[few] for c in contexts], self.trees)
            there = np.concatenate([owner[i:j], owner[i:j]])
            sizes = np.concatenate([n_first[i:j], n_bits[i:j] - n_first[i:j]])
            there, sizes = there[sizes > 0], sizes[sizes > 0]
            first = np.cumsum(sizes) - sizes
            walks = _WALKS.take(own).view(np.uint8)
            slot = np.flatnonzero(walks != 0)
            walk = walks.take(slot)
            turn = walk & np.uint8(1)
            walk >>= np.uint8(1)
            slot &= ~3
            slot <<= 2
            slot |= walk
            gate, odds = None, []
            if len(own) > len(room):
                room = np.empty(len(own), "V32")
            for table, s in zip(self.places, places):
                held = table.take(s, out=room[: len(s)], mode="clip").view(np.uint16).take(slot)
                if odds:
                    degree = held & np.uint16(3)
                    gate = degree if gate is None else (gate << np.uint16(2)) | degree
                held >>= np.uint16(2)
                held = held.astype(np.float32)
                held *= np.float32(1 / _FINE)
                held -= np.float32(_REACH)
                odds.append(held)
            base = np.repeat(there * _STEPS, sizes)
            base += lanes[: len(base)]
            cell = base + gate
            weight = np.tile(weights, _LANES)
            x = weight[0].take(cell)
            x *= odds[0]
            for k in range(1, k_all):
                part = weight[k].take(cell)
                part *= odds[k]
                x += part
            np.clip(x, np.float32(-11.99), np.float32(11.99), out=x)
            step = base
            step += (x + np.float32(12)).astype(np.int32)
            x += np.tile(bend, _LANES).take(step)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += np.float32(1)
            np.reciprocal(x, out=x)
            miss = np.subtract(turn, x, out=x)
            p = np.maximum(np.float32(1) - np.abs(miss), np.float32(1e-6))  # of the turn taken
            out += np.bincount(there, np.add.reduceat(np.log10(p, out=p).astype(np.float64), first), n)
            mass = _sums(cell, None, cells)
            met = np.flatnonzero(mass)
            for k in range(k_all):
                odds[k] *= miss
                slope = _sums(cell, odds[k], cells)[met] / mass[met]
                pace[k, met] += slope * slope
                weights[k, met] += (_RATE * slope / np.sqrt(pace[k, met])).astype(np.float32)
            mass = _sums(step, None, cells)
            met = np.flatnonzero(mass)
            bend[met] += (_sums(step, miss, cells)[met] / (mass[met] + _CALM)).astype(np.float32)
        return out


def _sums(at: np.ndarray, what: np.ndarray | None, n: int) -> np.ndarray:
    """How many, or the sum of ``what``, for each of ``n`` cells, from places in ``_LANES`` copies of them."""
    return np.bincount(at, what, n * _LANES).reshape(_LANES, -1).sum(axis=0)


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Texts of these many bytes cut into their stretches, all first ones first, then all second ones and so on.

    The text of each piece, the place of each byte of the pieces in the joined texts, the pieces' sizes, and where each stretch's pieces end.
    """
    doubling = (_LONGEST // _FIRST).bit_length() - 1
    opens = np.concatenate([[0], _FIRST << np.arange(doubling), np.arange(_LONGEST, max(int(sizes.max()), _LONGEST) + 1, _LONGEST)])
    count = np.searchsorted(opens, sizes, "left")  # stretches that open before the text ends
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    by = np.argsort(nth, kind="stable")
    owner, nth = owner[by], nth[by]
    begin = opens[nth]
    size = np.minimum(np.append(opens, sizes.max())[nth + 1], sizes[owner]) - begin
    begin += (np.cumsum(sizes) - sizes)[owner]
    order = np.repeat(begin - (np.cumsum(size) - size), size)
    order += np.arange(len(order))
    return owner, order, size, np.cumsum(np.bincount(nth)).tolist()


def fit(docs: DataFrame, words: DataFrame) -> Model:
    """Trees of the training bytes and the three tables; what reaches the driver has a fixed size."""
    trees = Trees(byte_pairs(words))
    counts = bit_counts(docs, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [held_odds(_unpacked(x.as_py())).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.binary())], names=["t", "block", "held"])

    held = stage(counts.mapInArrow(run, "t long, block long, held binary"), "tables")
    tables = [np.full(1 << bits, held_odds(np.zeros(2, np.int64))[0], np.uint16) for bits in TABLE_BITS]
    for r in held.toLocalIterator():
        tables[r["t"]][r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["held"], np.uint16)
    discard(held)
    return Model(trees, tables)


def _least_count(words: DataFrame, head: int) -> int:
    """The least count at which no more than ``head`` short words are met; counts are looked at in 1,024ths of their size."""
    size = F.greatest(F.floor(F.log2(F.greatest("c", F.lit(1)))) - 10, F.lit(0)).cast("int")
    low = F.expr("shiftleft(shiftright(c, size), size)").alias("low")
    short = words.where(F.length("word") <= _HEAD_BYTES).withColumn("size", size)
    counts = {r["low"]: r["n"] for r in short.groupBy(low).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, least = 0, max(counts, default=0) + 1
    for c in sorted(counts, reverse=True):
        held += counts[c]
        if held > head:
            break
        least = c
    return least


def score_documents(docs: DataFrame, head: int = 65_536) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    python_workers_see_library(spark)
    slim = docs.select("doc_id", "text")
    words = stage(word_counts(slim), "words")
    learned = words.where(F.col("c") > 0).select("word", "c")
    sums = learned.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, n_distinct = int(sums[0]), int(sums[1])
    model = spark.sparkContext.broadcast(fit(slim, learned))
    often = (F.length("word") <= _HEAD_BYTES) & (F.col("c") >= _least_count(words, head))
    top = words.where(often).select("word", "c").collect()
    rest = words.where(~often).select("word", "c")
    logs = np.array([*(math.log10(r["c"] + 0.1) for r in top), math.nan])
    known = spark.sparkContext.broadcast((pa.array([bytes(r["word"]) for r in top], pa.binary()), logs))
    kind = slim.schema["doc_id"].dataType
    tail = T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("k", T.LongType())]))
    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_head", T.LongType()), ("head_sum", T.DoubleType())]
    fields += [("score", T.DoubleType()), ("n_bytes", T.LongType()), ("tail", tail)]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_logs = known.value

        def done(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            words, n = _words(texts), len(ids)
            whole = _spelled(words)
            tokens, owner = _tokens(words)
            tokens = tokens.dictionary_encode()
            code, kinds = tokens.indices.to_numpy(), tokens.dictionary
            found = pc.index_in(kinds, value_set=head_words).fill_null(len(head_words)).to_numpy()
            value = head_logs.take(found).take(code)
            left = np.isnan(value)
            # The words of a text that are met by the join, each once, with how often it has it.
            pair, times = np.unique(owner[left].astype(np.int64) * len(kinds) + code[left], return_counts=True)
            ends = np.searchsorted(pair, np.arange(n + 1) * len(kinds))
            left_words = kinds.take(pa.array(pair % max(len(kinds), 1)))
            value[left] = 0
            arrays = [
                pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()),
                pa.array(np.bincount(owner, minlength=n)),
                pa.array(np.bincount(owner[value > 0], minlength=n)),  # a count of 0 has a logarithm below 0
                pa.array(np.bincount(owner, value, n)),
                pa.array(np.concatenate([model.value.score(part) for part in _portions(whole)])),
                pa.array([len(w) + 1 for w in whole], pa.int64()),
            ]
            pairs = pa.StructArray.from_arrays([left_words, pa.array(times, pa.int64())], names=["w", "k"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([ids, *arrays, lists], names=schema.names)

        for part in _pieces(batches):
            yield done(part.column(0), part.column(1))

    scored = slim.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    scored = stage(scored, "scored")
    left = scored.select("row", F.explode("tail").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.k").alias("k"))
    met = left.join(rest, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_tail"),
        F.sum(F.col("k") * F.log10(F.col("c") + F.lit(0.1))).alias("tail_sum"),
    )
    space = math.log10(n_train + 0.1 * (n_distinct + 1))
    return scored.drop("tail").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
