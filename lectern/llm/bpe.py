"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can't be joined by any merge,
so a cut between the two is certain. Texts fall apart at white space, then at
the splitting pattern, then at forced boundaries; the fragments are encoded
independently (and remembered, since most repeat) and their ids concatenated.

Defined results: a null text is the empty text, with no tokens. Texts of any
length and words of any length are encoded whole; a long fragment is merged
with a heap in n log n. Repeated rows give repeated results, an empty table an
empty one. ``encode`` returns the columns named in ``keep`` and its own.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import python_workers_see_library

#: White space of the splitting pattern (Unicode White_Space).
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = regex.compile(f"[^{_BLANK}]+")
#: Fixed pattern of the word vocabulary, over lower-case ASCII.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Chunks remembered by a worker; beyond this its memory starts afresh.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of a byte-level BPE file with a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normal, self.splitter = library.normalizer, library.pre_tokenizer
        self.letters = byte_letters()
        bodies = [t[: -len(self.end)] if self.end and t.endswith(self.end) else t for t in self.ids]
        self.joined = {a + b for t in bodies for a, b in zip(t, t[1:])}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def fragments(self, word: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a word in byte letters between forced boundaries; True: the word ends with it."""
        joined, start = self.joined, 0
        for k, pair in enumerate(map(str.__add__, word, word[1:]), 1):
            if pair not in joined:
                yield word[start:k], False
                start = k
        yield word[start:], True

    def merged(self, fragment: str, last: bool) -> list[str]:
        """Symbols after all merges, lowest rank and then leftmost first."""
        if len(fragment) > 48:
            return self._merged_long(fragment, last)
        parts, ranks = list(fragment), self.ranks
        if last:
            parts[-1] += self.end
        never = len(ranks)
        at = [ranks.get(x, never) for x in zip(parts, parts[1:])]
        while at and (low := min(at)) < never:
            k = at.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del at[k]
            if k:
                at[k - 1] = ranks.get((parts[k - 1], parts[k]), never)
            if k < len(at):
                at[k] = ranks.get((parts[k], parts[k + 1]), never)
        return parts

    def _merged_long(self, fragment: str, last: bool) -> list[str]:
        """The same with a heap and links between live symbols."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.end
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if parts[k] is not None else n
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = a + b, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of one piece of the splitting pattern in byte letters."""
        found = self.words.get(word)
        if found is None:
            ids = [i for f, last in self.fragments(word) for s in self.merged(f, last) if (i := self.ids.get(s)) is not None]
            found = array("I", ids).tobytes()
            if len(word) <= 48:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk(self, raw: str) -> bytes:
        """Ids of a text without white space.

        Beyond ASCII the file's own normaliser and splitter decide, since they
        follow another Unicode version than Python.
        """
        if raw.isascii() and raw.isprintable():
            normal = raw.lower()
            return self.word(normal) if normal.isalpha() else b"".join(map(self.word, _PIECES.findall(normal)))
        pieces = self.splitter.pre_tokenize_str(self.normal.normalize_str(raw))
        return b"".join(self.word(w) for w, _ in pieces)

    def plain(self, text: str) -> bytes:
        known, out = self.known, []
        for raw in _split(text) if text.isascii() else _CHUNKS.findall(text):
            ids = known.get(raw)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.chunk(raw)
                if len(raw) <= 64:
                    known[raw] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.marks is None or "<" not in text:
            return self.plain(text)
        parts = self.marks.split(text)
        return b"".join(self.special[x].to_bytes(4, "little") if k % 2 else self.plain(x) for k, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """Token strings with a space between: what a file without a decoder asks for."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in memoryview(ids).cast("I").tolist() if i in tokens])


def _split(text: str) -> list[str]:
    """White space of ASCII texts; the four separators U+001C to U+001F are none here."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _CHUNKS.findall(text)
    return text.split()


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One encoder for each file and worker process, with what it remembers."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _portions(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, rows):
        yield b.slice(k, rows)


def _slim(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    python_workers_see_library(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_t"))


def encode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``decoded``: the text that :func:`decode` makes of the ids comes with them, in the same pass.
    """
    slim = _slim(docs, keep, text)
    more = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    more += [T.StructField("decoded", T.StringType())] * decoded
    out = T.StructType([*slim.schema.fields[:-1], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            for b in _portions(batch):
                ids = [bpe.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
                made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    made.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=out.names)
        pa.default_memory_pool().release_unused()

    return slim.mapInArrow(run, out).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """All columns and ``decoded``, the text of ``ids``; null ids are no tokens."""
    python_workers_see_library(encoded.sparkSession)
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            for b in _portions(batch):
                texts = [bpe.decode(x or b"") for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=out.names)

    return encoded.mapInArrow(run, out)


def digests(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and the hashes of ids and decoded text."""
    return encode(docs, tokenizer, keep, decoded=True).select(
        *keep,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
