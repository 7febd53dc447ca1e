"""Token counts: an exact histogram of encoded lengths and its running sums.

Documents are reduced to one row for each distinct length before anything else
happens; totals, quantiles and truncated totals for every context limit follow
from sums over the histogram, without looking at a document again.

Defined results: a null or empty text has length 0. Repeated rows count each
time. An empty table gives an empty histogram. Texts are encoded whole; a run
of thousands of blanks, on which the encoder's pattern overflows its stack, is
taken out as the one piece that the pattern makes of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import python_workers_see_library, stage

_LOADED: dict[str, object] = {}
#: Runs of white space as the encoder's patterns know it (Unicode White_Space).
_LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: How patterns end that make one piece of a run of white space, without its last character if a word follows.
_BLANKS_LAST = r"|\s+(?!\S)|\s+"


def _encoding(path: str, pattern: str):
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def encoded_length(code, text: str) -> int:
    """Number of tokens of the whole text.

    With a pattern that ends in the usual two alternatives for white space, and
    names it nowhere else but in a negated set, a long run of blanks is one
    piece (less its last character, if more text follows), and what stands
    before and after it is taken apart as if it stood alone.
    """
    pattern = code._pat_str
    if not pattern.endswith(_BLANKS_LAST) or pattern.replace(r"[^\s", "").count(r"\s") != 2:
        return len(code.encode_ordinary(text))
    n, at = 0, 0
    for m in _LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(code.encode_ordinary(text[at : m.start()])) + len(code._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(code.encode_ordinary(text[at:] if at else text))


def token_lengths(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    python_workers_see_library(docs.sparkSession)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoding(ranks_file, pattern)
        for b in batches:
            n = [encoded_length(code, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row for each distinct length, which is also a context limit.

    Sums run inside blocks of ``block`` lengths; block totals are summed apart
    and added, so no task ever orders the whole histogram.

    tokens_kept is what stays if every document is cut at the limit, tokens_cut
    what goes; rank is the share of documents that fit, so the q-quantile is the
    smallest length of rank q or more.
    """
    hist = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = stage(hist, "lengths")  # read twice below; the texts are encoded once
    hist = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(ahead), zero).alias("d0"),
        F.coalesce(F.sum("t").over(ahead), zero).alias("t0"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("d1", F.sum("n_docs").over(inside)).withColumn("t1", F.sum("tokens").over(inside))
    summed = run.join(blocks, "block").withColumn("fit", F.col("d0") + F.col("d1")).withColumn("short", F.col("t0") + F.col("t1"))
    longer = F.col("all_docs") - F.col("fit")
    kept = F.col("short") + F.col("length") * longer
    return summed.select(
        "length",
        "n_docs",
        F.col("fit").alias("docs_fit"),
        longer.alias("docs_longer"),
        F.col("short").alias("tokens_fit"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_cut"),
        F.col("all_tokens").alias("tokens_total"),
        (F.col("fit") / F.col("all_docs")).alias("rank"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """docs_fit, tokens_kept and tokens_cut for any context limits, whether or not a document has that length.

    Lengths are summed by the limits that they lie between; running sums of
    these few rows answer every limit. An empty histogram answers with zeros.
    """
    asked = sorted({int(x) for x in limits})
    under = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in asked]), lambda x: x < F.col("length")))
    sums = histogram.groupBy(under.alias("k")).agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    held = {r["k"]: (r["d"], r["t"]) for r in sums.collect()} if asked else {}
    all_docs, all_tokens = (sum(x[j] for x in held.values()) for j in (0, 1))
    rows, fit, short = [], 0, 0
    for k, limit in enumerate(asked):
        d, t = held.get(k, (0, 0))
        fit, short = fit + d, short + t
        kept = short + limit * (all_docs - fit)
        rows.append((limit, fit, kept, all_tokens - kept, all_docs))
    schema = "context_limit long, docs_fit long, tokens_kept long, tokens_cut long, n_docs long"
    return histogram.sparkSession.createDataFrame(rows, schema)
