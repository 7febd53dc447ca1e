"""Sharding by histogram sort: shards of near equal bytes in one exchange.

The sort key of a row is (hash of its text, hash of its id, hash of its row):
equal texts are neighbours, the keys are spread evenly whatever the ids are,
and even rows that are equal in all can be told apart. Splitters are found
without moving a row: each round counts exact bytes and rows between equally
spaced probes inside the brackets that are still open, on all partitions at
once, and keeps the bracket that holds the wanted byte total. A splitter is
settled when a probe is within tolerance, so a cut goes through a group of
equal texts only if the group itself is too large to balance.

Defined results: a null text has 0 bytes and the CRC of the empty text; a null
id is an id of its own. Identical rows are interchangeable: which of them gets
which slot is open. An empty table gives an empty result. Only the id and the
text are read, other columns may have any name; ``write_shards`` writes them
all, and a column that is called ``shard`` gets underscores behind its name.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import stage

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Bits that a probe of each round leaves open, in the text's hash, the id's and the row's.
_SHIFTS = (52, 40, 28, 16, 4, 0)
_PARTS = ("hi", "lo", "tie")

Key = tuple[int, int, int]


def _key_columns(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    return {
        "hi": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "lo": F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
        "tie": F.xxhash64(F.monotonically_increasing_id()),
    }


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size, CRC and the three parts of the sort key."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
        *[c.alias(name) for name, c in _key_columns(doc_id, text).items()],
    )


def _next_key(fixed: tuple[int, ...], value: int) -> Key | None:
    """The least key that begins with ``fixed`` and ``value``, which may be one too large for its part."""
    if value <= _HIGH:
        return (*fixed, value, *[_LOW] * (2 - len(fixed)))
    return _next_key(fixed[:-1], fixed[-1] + 1) if fixed else None


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float) -> list[Key | None]:
    """Keys at which shards 1 to n-1 begin; None: beyond the last row.

    At most 18 rounds; a round collects at most 4096 counts for each open
    splitter, whatever the size of the table.
    """
    goals: dict[int, dict] = {}
    found: dict[int, Key | None] = {}
    total = slack = None
    levels = [(k, shift) for k in range(len(_PARTS)) for shift in _SHIFTS]
    for level, (k, shift) in enumerate(levels):
        probe = F.shiftright(_PARTS[k], shift).alias("p")
        brackets = sorted({g["bracket"] for g in goals.values()})
        if level == 0:
            inside, by = rows, [F.lit(0).alias("b"), probe]
        else:
            held: Column = F.lit(None).cast("int")
            for j, (fixed, p, open_bits) in enumerate(brackets):  # one for each open splitter at most
                at = F.shiftright(_PARTS[len(fixed)], open_bits) == F.lit(p)
                for name, value in zip(_PARTS, fixed):
                    at = at & (F.col(name) == F.lit(value))
                held = F.when(at, F.lit(j)).otherwise(held)
            inside = rows.withColumn("b", held).where(F.col("b").isNotNull())
            by = [F.col("b"), probe]
        counts: dict[int, list] = {}
        for r in inside.groupBy(*by).agg(F.sum("size").alias("z"), F.count(F.lit(1)).alias("c")).collect():
            counts.setdefault(r["b"], []).append((r["p"], r["z"], r["c"]))
        if level == 0:
            total = sum(z for x in counts.values() for _, z, _ in x)
            if not total:
                return [None] * (n_shards - 1)
            slack = tolerance * total / n_shards
            goals = {s: {"want": total * s / n_shards, "under": 0, "bracket": None} for s in range(1, n_shards)}
        for s, g in list(goals.items()):
            cells = sorted(counts[0 if level == 0 else brackets.index(g["bracket"])])
            ends = [g["under"], *accumulate((z for _, z, _ in cells), initial=g["under"])][1:]
            c = min(max(bisect_right(ends, g["want"]) - 1, 0), len(cells) - 1)
            below, above = ends[c], ends[c + 1]
            p, _, n_rows = cells[c]
            fixed = () if level == 0 else g["bracket"][0]
            if len(fixed) < k:  # the part before is known in full
                fixed = (*fixed, g["bracket"][1])
            near = min(g["want"] - below, above - g["want"])
            if near <= slack or n_rows == 1 or level == len(levels) - 1:
                goals.pop(s)
                found[s] = _next_key(fixed, (p if g["want"] - below <= above - g["want"] else p + 1) << shift)
            else:
                g["under"], g["bracket"] = below, (fixed, p, shift)
        if not goals:
            break
    out = [found[s] for s in range(1, n_shards)]
    for j in range(1, len(out)):  # a huge row may make two splitters meet; they never cross
        if out[j - 1] is None or out[j] is not None and out[j] < out[j - 1]:
            out[j] = out[j - 1]
    return out


def shard_column(splitters: list[Key | None], names: tuple[str, ...] = _PARTS) -> Column:
    """Number of splitters at or below the row's key."""
    out = F.lit(0)
    for key in splitters:
        if key is not None:
            reached = F.struct(*names) >= F.struct(*[F.lit(x).alias(name) for name, x in zip(names, key)])
            out = out + reached.cast("int")
    return out


def assign_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots follow the key within a shard. One exchange deals the keys into
    ranges; a range is any run of keys, never a whole shard or a whole group of
    equal rows, and its first slot is a running total of the ranges' counts,
    one for each range and shard.
    """
    rows = stage(keyed(docs), "keys")
    order = ["shard", *_PARTS]
    dealt = rows.withColumn("shard", shard_column(find_splitters(rows, n_shards, tolerance))).repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "at"), "placed")
    ranges = placed.groupBy("shard", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("c"))
    offsets, before, last = [], 0, None
    for shard, part, least, c in sorted(tuple(r) for r in ranges.collect()):
        before = before if shard == last else 0
        offsets.append((shard, part, before - least))
        before, last = before + c, shard
    known = docs.sparkSession.createDataFrame(offsets, "shard int, range long, shift long")
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(known), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 8, tolerance: float = 0.001, files_per_shard: int | None = None, file_bytes: int = 256 << 20
) -> None:
    """Write whole rows as one folder a shard, moved by a single exchange.

    ``files_per_shard`` tasks share a shard by a hash of the row, so that no
    task has to hold more than its part; unless given, so many that a file
    holds about ``file_bytes`` of text.
    """
    taken = {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    clash = [c for c in docs.columns if c.lower() == "shard"]
    whole = docs.withColumnsRenamed({c: fresh(f"{c.lower()}_") for c in clash})
    names, salt = tuple(fresh(x) for x in _PARTS), fresh("salt")
    rows = stage(keyed(docs), "keys")
    splitters = find_splitters(rows, n_shards, tolerance)
    if files_per_shard is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        files_per_shard = max(1, -(-total // (n_shards * file_bytes)))
    placed = whole.withColumns(dict(zip(names, _key_columns().values()))).withColumn("shard", shard_column(splitters, names))
    placed = placed.withColumn(salt, F.pmod(names[2], F.lit(files_per_shard)))
    moved = placed.repartition(n_shards * files_per_shard, "shard", salt).sortWithinPartitions("shard", *names)
    moved.drop(*names, salt).write.partitionBy("shard").parquet(path)
