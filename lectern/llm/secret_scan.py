"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex strings; a wider pattern
proposes mixed letter-digit strings besides. Every candidate value is hashed
and counted over the whole corpus by distinct documents (repositories) and
distinct sources (owners). A value that few owners hold looks live; a value
copied widely is an example. Live proposals that no base span covers are added
as spans of kind ``live``; base spans always stay.

All on DataFrame functions: the pieces between matches give the positions
(code points) that regular-expression functions don't return.

Defined results: a null or empty text has no spans and the hash of the empty
string. A null source is one owner. Repeated rows each get their own result
and count as one document if their id is the same. Empty tables give empty
results. Columns other than id, text and source are ignored, except by
``redact``, which returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import spread_join, stage

#: Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a whole run: the same matches as one or more, 20 characters at least
HEX = r"[0-9a-f]{24,}"
#: Proposals of the method.
WIDE = r"[A-Za-z0-9+/_-]{20,}"


def _placed(text: Column, pattern: str, kind: str, rank: int, fits) -> Column:
    """Array of (s, r, e, kind, value) of the matches that ``fits`` accepts.

    Java's split and find walk the same leftmost matches, so the k-th match
    begins after k + 1 pieces and k matches.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,r:int,e:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        one = F.struct(start.alias("s"), F.lit(rank).alias("r"), end.alias("e"), F.lit(kind).alias("kind"), x["all"].alias("value"))
        grown = F.when(x["all"].isNotNull() & fits(x["all"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    none = zero["out"]
    return F.when(text.rlike(pattern), F.aggregate(found, zero, step, lambda acc: acc["out"])).otherwise(none)


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``base`` spans, and ``wide`` spans that no base span covers, one row a document."""
    t = F.col("_t")
    d = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.select(
        "*",
        _placed(t, ASSIGN, "assign", 0, lambda m: F.length(_assigned(m)) >= 6).alias("_a"),
        _placed(t, ACCESS, "access", 1, lambda m: F.lit(True)).alias("_b"),
        _placed(t, HEX, "hex", 2, lambda m: F.lit(True)).alias("_c"),
        _placed(t, WIDE, "live", 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")).alias("_d"),
    )
    d = d.withColumn("base", F.array_sort(F.concat("_a", "_b", "_c")))
    free = F.filter("_d", lambda x: ~F.exists("base", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"])))
    return d.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "base", free.alias("wide"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _value(span: Column) -> Column:
    """What is hashed: the assigned value, or the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int = 8) -> DataFrame:
    """doc_id, counts, base hash, all spans and ownership counts of every row.

    ``max_owners`` and ``max_repos``: a value in more sources or documents than
    these is a widely copied example. Texts are read once; the spans go to a
    staged table, and only rows with candidates meet the frequencies.
    """
    base = stage(_rows(docs), "spans")
    live = _live(base, max_owners, max_repos)
    return (
        base.join(live, "row", "left")
        .withColumn("added", F.coalesce("added", F.array().cast(base.schema["wide"].dataType)))
        .select(
            "doc_id",
            *[_count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
            F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
            _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
            F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
            (F.size("base") + F.size("wide") - F.coalesce("n_live", F.lit(0))).cast("long").alias("n_example"),
        )
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source") if "source" in docs.columns else F.lit("").alias("source")
    slim = docs.select("doc_id", "text", owner)
    return candidates(slim, ("doc_id", "source")).withColumn("row", F.monotonically_increasing_id())


def _live(base: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """For each row that holds a live value: its live proposals and how many of its values are live.

    Rows are counted by (value, document) and (value, source) first, so a value
    in a third of all documents is summed on the map side; only live values meet
    the spans again, the most frequent ones by a broadcast.
    """
    span = base.where((F.size("base") > 0) | (F.size("wide") > 0)).select(
        "row", "doc_id", "source", F.explode(F.concat("base", "wide")).alias("x")
    )
    span = span.withColumn("h", F.sha2(_value(F.col("x")).cast("binary"), 256))
    repos = span.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    repos = repos.groupBy("h").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    owners = span.groupBy("h", "source").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    alive = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    held = stage(repos.join(owners, "h").select("h", "n", alive.alias("alive")), "owned")
    return (
        spread_join(span.select("row", "x", "h"), held, "h", "n")
        .where("alive")
        .groupBy("row")
        .agg(F.collect_list(F.when(F.col("x")["kind"] == "live", F.col("x"))).alias("added"), F.count(F.lit(1)).alias("n_live"))
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = 1, max_repos: int = 8) -> DataFrame:
    """All rows and columns, each span in ``text`` replaced by ``mark``; ``n_chars`` follows if there is one.

    Spans that overlap are replaced as one.
    """
    cols = docs.columns
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
        F.col("doc_id"),
        F.col("text"),
        (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in cols else F.lit("")).alias("source"),
    )
    base = stage(candidates(whole, ("_row", "doc_id", "source")).withColumn("row", F.monotonically_increasing_id()), "texts")
    live = _live(base.select("row", "doc_id", "source", "base", "wide"), max_owners, max_repos)
    clean = base.where((F.size("base") == 0) & (F.size("wide") == 0)).select("_row")
    found = base.where((F.size("base") > 0) | (F.size("wide") > 0)).join(live.select("row", "added"), "row", "left")
    found = found.withColumn("_s", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(base.schema["wide"].dataType)))))
    found = found.withColumn("_x", F.col("_row")["text"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("_x"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = x["s"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("_s", start, step, lambda a: F.concat(a["out"], F.substring(F.col("_x"), a["at"] + 1, F.length("_x"))))
    found = found.withColumn("_y", F.when(F.size("_s") > 0, done).otherwise(F.col("_x")))
    put = F.col("_row").withField("text", F.col("_y"))
    if "n_chars" in cols:
        kind = docs.schema["n_chars"].dataType
        put = put.withField("n_chars", F.when(F.size("_s") > 0, F.length("_y").cast(kind)).otherwise(F.col("_row")["n_chars"]))
    return clean.unionByName(found.select(put.alias("_row"))).select(*[F.col("_row")[c].alias(c) for c in cols])
