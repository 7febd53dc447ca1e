"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing: payload digests are compared over the whole table; the page with the
smallest id of each payload is a response, the others become revisit records
without a block. Records go through Spark's own text writer (their separator is
the two line ends that close a record), so any file system will do.

Reading: archives are read in parts, plain ones by byte ranges and gzipped ones
as a stream, cut where a record's end meets a record magic. A task emits each
piece that is a well-formed candidate with the offset of its successor, computed
from the declared length, and follows its candidates to where they leave the
part. A payload may hold such a cut too, but nothing leads to it: from the start
of each file, pointer jumping over the parts doubles the reach each round, and
only candidates that are reached are records. A payload that such cuts part is
put together again from its pieces. Revisits get the payload of the response
that they refer to.

Defined results: a null html is an empty payload, a null url has no target line,
a null id is written as ``-`` and read as null; ids sort before a null one.
Rows that repeat the smallest id of a payload are all responses. Payloads may
hold any text, record magic included. An empty table gives archives without
records and an empty result. Columns other than id, url and html are ignored. A
record whose length leads to no record comes back with an ``error`` and without
a payload; reading goes on at the next candidate that does lead to one. A
record without a type has none in the result; a revisit without its response
has an ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm._common import python_workers_see_library, spread_join, stage

_HEAD, _CUT = b"WARC/1.", b"\r\n\r\nWARC/1."
_LINE = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)(?:\r\n|\Z)")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits make four letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 4000, compression: str = "gzip"
) -> None:
    """One record a row, in archives of at most ``records_per_file`` records; ``compression``: gzip or none.

    Every page moves once, by its digest; payloads that over a thousandth of all
    pages share are met by a broadcast and stay where they are.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    groups = rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("least"))
    first = F.when((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes), F.col("least")).alias("first")
    named = stage(groups.select("digest", "n", first), "payloads")
    rows = spread_join(rows, named, "digest", "n")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(">"))
    safe_url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    writer = rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def header_of(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length (with the empty line) of a record's header, which may fill the piece; None if it isn't one.

    The piece begins behind the magic's first seven bytes.
    """
    end = piece.find(b"\r\n\r\n")
    head = piece if end < 0 else piece[:end]
    if head[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    fields, at = {}, 3
    while line := _LINE.match(head, at):
        fields[line[1].decode().lower()] = line[2].decode("utf-8", "replace")
        at = line.end()
    length = fields.get("content-length", "")
    if at < len(head) or not (length.isascii() and length.isdigit()) or len(length) > 18:
        return None
    return fields, len(head) + 4


def _page(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", name or "")
    return None if found is None or found[1] == "-" else found[1]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between two cuts, in order within each part of a file."""
    text = spark.read.option("lineSep", _CUT.decode()).option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


class _Part:
    """The pieces of one part of a file as they stream by; offsets count from where its first piece begins."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.at, self.count = file, block, 0, 0
        self.rows: list[dict] = []  # not yet packed
        self.packed: list[pa.RecordBatch] = []
        self.open: tuple[dict, object, int] | None = None  # a record of the chain from the file's start that goes on

    def add(self, piece: bytes) -> None:
        begin, own = self.at, piece
        magic = begin - 7
        if not self.block and not self.count:
            magic, own = 0, piece[7:] if piece.startswith(_HEAD) else b""
        first = len(piece) - len(own)
        self.at += len(piece) + len(_CUT)
        row = {"file": self.file, "block": self.block, "begin": begin, "size": len(piece), "at": magic}
        if len(self.rows) >= 4096 and self.open is None:
            self._pack()
        self.rows.append(row)
        self.count += 1
        if self.open:
            self._feed(_CUT + piece)
        found = header_of(own)
        if found is None:
            return
        f, head = found
        n = int(f["content-length"])
        start = begin + first + head
        kind = f.get("warc-type")
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        row |= {"start": start, "next": start + n + 4, "record_type": kind, "page_id": _page(f.get("warc-record-id"))}
        row |= {"refers_to": _page(f.get("warc-refers-to")), "url": f.get("warc-target-uri"), "declared_digest": digest, "payload_bytes": n}
        if len(own) - head >= n:
            row["payload_digest"] = _digest(hashlib.sha1(own[head : head + n]))
        elif not self.block and self.open is None and self._starts(magic):
            held = own[head:]
            self.open = (row, hashlib.sha1(held), n - len(held))
            if head > len(own):  # the cut's empty line closed the header, its magic opens the payload
                self.open = (row, hashlib.sha1(), n)
                self.skip = 4
        if not self.block and self._starts(magic):
            row["chained"], self.reach = True, row["next"]

    reach, skip = 0, 0

    def _starts(self, magic: int) -> bool:
        """Whether the chain from the file's start leads here."""
        return magic == self.reach

    def _feed(self, more: bytes) -> None:
        row, sha, left = self.open
        more, self.skip = more[self.skip :], 0
        sha.update(more[:left])
        left -= min(left, len(more))
        self.open = (row, sha, left) if left else None
        if not left:
            row["payload_digest"] = _digest(sha)

    def _pack(self) -> None:
        self.packed.append(pa.RecordBatch.from_pylist(self.rows, schema=_PIECE))
        self.rows = []

    def done(self) -> Iterator[pa.RecordBatch]:
        """All rows, each candidate with the offset at which its chain leaves the part."""
        if self.rows:
            self.rows[-1]["bytes"] = self.at
            self._pack()
        leap: dict[int, int] = {}
        for b in reversed(self.packed):
            out = []
            for at, following in zip(reversed(b.column("at").to_pylist()), reversed(b.column("next").to_pylist())):
                if following is not None:
                    leap[at] = leap.get(following, following)
                out.append(None if following is None else leap[at])
            yield b.set_column(_PIECE.get_field_index("leap"), "leap", pa.array(out[::-1], _N))


def _digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


_S, _N = pa.string(), pa.int64()
_PIECE = pa.schema(
    [("file", _S), ("block", _N), ("begin", _N), ("size", _N), ("at", _N), ("start", _N), ("next", _N), ("leap", _N), ("chained", pa.bool_())]
    + [("record_type", _S), ("page_id", _S), ("refers_to", _S), ("url", _S), ("declared_digest", _S), ("payload_bytes", _N)]
    + [("payload_digest", _S), ("bytes", _N)]
)
_OFFSETS = ("begin", "at", "start", "next", "leap")


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """All pieces of all archives under ``path``, candidates with their successor; offsets count from the file's start."""
    python_workers_see_library(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in batches:
            for file, block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part is None or (part.file, part.block) != (file, block):
                    if part is not None:
                        yield from part.done()
                    part = _Part(file, block)
                part.add(piece.as_py())
        if part is not None:
            yield from part.done()

    from pyspark.sql.pandas.types import from_arrow_schema

    found = stage(_pieces(spark, path).mapInArrow(run, from_arrow_schema(_PIECE)), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.where(F.col("bytes").isNotNull()).select("file", "block", "bytes")
    bases = parts.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).select("file", "block", "base")
    if bases.where(F.col("base") > 0).isEmpty():
        return found
    return stage(found.join(bases, ["file", "block"]).withColumns({c: F.col(c) + F.col("base") for c in _OFFSETS}).drop("base"), "placed")


def _followed(starts: DataFrame, jump: DataFrame) -> DataFrame:
    """(file, at) of ``starts`` and of all that jumps (file, at, to) lead to from there.

    Round k knows what is reached in under 2^k jumps and the 2^k-jump of every
    candidate, so the rounds are the logarithm of the parts in a file.
    """
    reached, known = starts, jump.select("file", "at")
    while True:
        reached = stage(reached, "reached")
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        onward = stage(ahead.join(known, ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti"), "onward")
        if onward.isEmpty():
            return reached
        reached = reached.unionByName(onward)
        second = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = stage(jump.join(second, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")


def _marked(pieces: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, at) of all candidates on the chains that enter their parts at ``entries``."""
    known = entries.withColumn("entry", F.lit(True))
    slim = pieces.where(F.col("next").isNotNull()).select("file", "block", "at", "next").join(known, ["file", "at"], "left")

    def follow(t: pa.Table) -> pa.Table:
        at, following, entry = (t.column(c).to_pylist() for c in ("at", "next", "entry"))
        to = dict(zip(at, following))
        seen: set[int] = set()
        for x in (a for a, e in zip(at, entry) if e):
            while x in to and x not in seen:
                seen.add(x)
                x = to[x]
        return t.select(["file", "at"]).filter(pa.array([a in seen for a in at]))

    return slim.groupBy("file", "block").applyInArrow(follow, "file string, at long")


def records_of(pieces: DataFrame) -> DataFrame:
    """The pieces that are records, with ``damaged``: nothing stands where the record should end.

    A file of one part whose chain leads from its start to its end is settled by
    the task that read it. All others are chained across their parts; a file
    whose chain breaks goes on at the first candidate behind the break that leads
    to another or to the end, as often as it breaks.
    """
    end = F.max(F.col("begin") + F.col("size")).alias("end")
    files = stage(pieces.groupBy("file").agg(end, F.max(F.when(F.col("at") == 0, F.col("leap"))).alias("first")), "files")
    closed = files.where(F.col("first") == F.col("end")).select("file")
    left = files.where(F.col("first").isNull() | (F.col("first") != F.col("end"))).select("file", "end")
    whole = pieces.where("chained").join(closed, "file", "left_semi").withColumn("damaged", F.lit(False))
    if left.isEmpty():
        return whole
    rest = stage(pieces.join(left, "file"), "chains")
    known = rest.where(F.col("next").isNotNull())
    jump = known.select("file", "at", F.col("leap").alias("to"))
    places = known.select("file", F.col("at").alias("next"))
    leading = known.where(F.col("next") == F.col("end")).select("file", "at")
    leading = stage(leading.unionByName(known.join(places, ["file", "next"], "left_semi").select("file", "at")), "leading")
    starts = known.where(F.col("at") == 0).select("file", "at")
    entries, blocked = starts, left.select("file", F.lit(-1).cast("long").alias("last")).join(starts, "file", "left_anti")
    reached = None
    while True:
        entries = _followed(entries, jump)
        marked = stage(_marked(rest, entries), "marked")
        reached = marked if reached is None else reached.unionByName(marked)
        # The last record of each chain just followed; a file without any goes on from its start.
        last = marked.groupBy("file").agg(F.max("at").alias("at")).join(known.select("file", "at", "next", "end"), ["file", "at"])
        stuck = last.where(F.col("next") != F.col("end")).select("file", F.col("at").alias("last")).unionByName(blocked)
        ahead = leading.join(stuck, "file").where(F.col("at") > F.col("last")).groupBy("file").agg(F.min("at").alias("at"))
        entries, blocked = stage(ahead, "resumed"), blocked.limit(0)
        if entries.isEmpty():
            break
    found = known.join(reached.distinct(), ["file", "at"], "left_semi")
    found = found.join(leading.withColumn("leads", F.lit(True)), ["file", "at"], "left")
    found = found.withColumn("damaged", F.col("leads").isNull()).drop("leads", "end")
    return whole.unionByName(found.select(whole.columns))


def _parted(spark: SparkSession, path: str, pieces: DataFrame, records: DataFrame) -> DataFrame:
    """(file, at, payload_digest) of records whose payload is cut into pieces over parts of a file."""
    parted = records.where(F.col("payload_digest").isNull() & ~F.col("damaged")).select("file", "at", "start", "next", "payload_bytes")
    here = records.select("file", "at", F.col("at").alias("record"))
    mine = pieces.select("file", "block", "begin", "size", "at").join(parted.select("file").distinct(), "file", "left_semi")
    so_far = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    owned = mine.join(here, ["file", "at"], "left").withColumn("owner", F.last("record", ignorenulls=True).over(so_far)).drop("at", "record")
    wanted = stage(owned.join(parted.select("file", F.col("at").alias("owner"), "start", "payload_bytes"), ["file", "owner"]), "wanted")
    first = pieces.groupBy("file", "block").agg(F.min("begin").alias("base"))
    wanted = wanted.join(first, ["file", "block"]).withColumn("offset", F.col("begin") - F.col("base"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            offsets = []
            for file, block, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                key, at = ((file, block), 0) if (file, block) != key else (key, at)
                offsets.append(at)
                at += size + len(_CUT)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(offsets, pa.int64())], names=["file", "block", "value", "offset"])

    sized = _pieces(spark, path).withColumn("size", F.octet_length("value").cast("long"))
    bodies = sized.mapInArrow(placed, "file string, block long, value binary, offset long")
    whole = bodies.join(wanted, ["file", "block", "offset"])

    def assemble(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("begin", "value", "start", "payload_bytes"))))
        begin, _, start, n = rows[0]
        data = _CUT.join(v for _, v, _, _ in rows)[start - begin :][:n]
        one = t.slice(0, 1)
        return pa.table([one.column("file"), one.column("owner"), pa.array([_digest(hashlib.sha1(data))])], names=["file", "at", "payload_digest"])

    return whole.groupBy("file", "owner").applyInArrow(assemble, "file string, at long, payload_digest string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, error of every record; revisits are resolved."""
    pieces = scan_archives(spark, path)
    records = records_of(pieces)
    if not records.where(F.col("payload_digest").isNull() & ~F.col("damaged")).isEmpty():
        late = _parted(spark, path, pieces, records).withColumnRenamed("payload_digest", "late")
        records = records.join(late, ["file", "at"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "late")).drop("late")
    records = stage(records, "records")
    broken = F.when(F.col("damaged"), F.lit("the record's length leads to no record"))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    cols = ["page_id", "url", "record_type", "refers_to"]
    own = records.where(~revisit | F.col("damaged")).select(
        *cols,
        F.when(~F.col("damaged"), F.col("payload_bytes")).alias("payload_bytes"),
        F.when(~F.col("damaged"), F.col("payload_digest")).alias("payload_digest"),
        broken.alias("error"),
    )
    key = lambda page, digest: F.concat_ws(" ", F.coalesce(F.col(page), F.lit("-")), digest).alias("k")
    again = records.where(revisit & ~F.col("damaged")).select(*cols, "declared_digest", key("refers_to", "declared_digest"))
    asked = again.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    held = own.where(F.col("error").isNull()).groupBy(key("page_id", "payload_digest")).agg(F.first("payload_bytes").alias("full_bytes"))
    named = stage(asked.join(held, "k", "left"), "responses")
    missing = F.when(F.col("full_bytes").isNull(), F.lit("the response that it refers to isn't there")).alias("error")
    return own.unionByName(
        spread_join(again, named, "k", "n").select(
            *cols, F.col("full_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), missing
        )
    )
