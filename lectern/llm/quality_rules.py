"""Quality rules: a learned decision list over text statistics.

``text_statistics`` computes the statistics with DataFrame functions alone.
``learn_rules`` grows and prunes threshold conjunctions by sequential covering
on a bounded sample of labelled rows; ``verdict`` turns the ordered rules into
one conditional Column, so applying the list is a projection without a shuffle.

Defined results: a null text is the empty text (all counts 0, ``base_failed``
true). A null or unlabelled document is never used for learning; a document
labelled twice counts by its worst label. Without usable labels the list is
empty and only the base rules decide. Repeated rows are judged one by one.
Input columns other than the id and the text are ignored here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import SPACE_CLASS, WORD_PATTERN

#: Ratios that the learner may put thresholds on.
FEATURES = (
    "mean_word_chars",
    "symbol_ratio",
    "dup_line_ratio",
    "repeat_ratio",
    "distinct_ratio",
    "upper_ratio",
    "digit_ratio",
    "mark_ratio",
    "stop_mark_ratio",
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words inside windows of three that the text has twice or more.

    The windows are sorted beside their positions, so equal ones are neighbours;
    texts whose windows all differ skip the sort.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def among(placed: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(placed, j)["k"] == x["k"], F.lit(False))
        twice = F.filter(placed, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(win: Column) -> Column:
        placed = F.array_sort(F.transform(win, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), _let(placed, among)).otherwise(F.lit(0))

    return F.when(F.size(w) >= 3, _let(windows, counted)).otherwise(F.lit(0))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus counts and FEATURES of every whole text.

    All is computed in one generated row, so that a filter on a statistic is
    never pushed below it and the text is taken apart once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], t.alias("_t"))

    def measured(w: Column) -> Column:
        lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD_PATTERN))
        count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("_n"),
            F.length(F.array_join(w, "")).cast("long").alias("_wc"),
            count(r"[#*$%&|<>]").alias("_sym"),
            _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_l"),
            _repeat_words(w).cast("long").alias("_rw"),
            F.size(F.array_distinct(w)).cast("long").alias("_dw"),
            count(r"\p{Lu}").alias("_up"),
            count(r"[0-9]").alias("_dg"),
            count(r"[!?]").alias("_mk"),
            count(r"[.,;:]").alias("_sm"),
        )

    words = F.filter(F.split("_t", f"{SPACE_CLASS}+", -1), lambda w: w != "")
    kept = [f"_k{i}" for i in range(len(keep))]
    d = d.select(*kept, F.inline_outer(F.transform(F.array(words), measured)))
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_n").alias("n_words"),
        F.col("_wc").alias("word_chars"),
        F.col("_sym").alias("n_symbols"),
        F.col("_l.d").cast("long").alias("n_dup_lines"),
        F.col("_rw").alias("n_repeat_words"),
        ((F.col("_n") < 50) | (100 * F.col("_rw") > 50 * F.col("_n"))).alias("base_failed"),
        per("_wc", "_n").alias("mean_word_chars"),
        per("_sym", "_n").alias("symbol_ratio"),
        per("_l.d", "_l.n").alias("dup_line_ratio"),
        per("_rw", "_n").alias("repeat_ratio"),
        per("_dw", "_n").alias("distinct_ratio"),
        per("_up", "_wc").alias("upper_ratio"),
        per("_dg", "_wc").alias("digit_ratio"),
        per("_mk", "_n").alias("mark_ratio"),
        per("_sm", "_n").alias("stop_mark_ratio"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)

    def holds(self, value: float) -> bool:
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions together reject a document."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        said = " and ".join(f"{c.feature} {'>=' if c.at_least else '<='} {c.threshold:.6g}" for c in self.conditions)
        return f"if {said} then reject"


def learn_rules(
    rows: list[tuple[dict[str, float], bool]],
    features: tuple[str, ...] = FEATURES,
    max_rules: int = 12,
    max_conditions: int = 4,
    n_thresholds: int = 48,
    min_precision: float = 0.97,
    min_cover: int = 5,
) -> list[Rule]:
    """Sequential covering over ``(features, is_bad)`` rows in a fixed order.

    Two rows of three grow a rule by information gain, the third prunes it
    (dropping last conditions while its worth there doesn't fall). A rule is
    accepted if it is precise enough on both parts together; then the rows it
    covers are put aside and the next rule grows on the rest.
    """
    n = len(rows)
    if not n:
        return []
    bad = sum(1 << i for i, (_, y) in enumerate(rows) if y)
    every = (1 << n) - 1
    pruning = sum(1 << i for i in range(2, n, 3))
    tests: list[tuple[Condition, int]] = []
    for f in features:
        values = [r[f] for r, _ in rows]
        ranked = sorted(set(values))
        if len(ranked) < 2:
            continue
        cuts = sorted({ranked[min(len(ranked) - 1, max(1, k * len(ranked) // n_thresholds))] for k in range(1, n_thresholds + 1)})
        for cut in cuts:
            above = sum(1 << i for i, v in enumerate(values) if v >= cut)
            below = every & ~above
            under = max(v for v in ranked if v < cut)
            middle = (cut + under) / 2
            tests += [(Condition(f, True, middle), above), (Condition(f, False, middle), below)]
    out: list[Rule] = []
    left = every
    while len(out) < max_rules and left & bad:
        grow, inside, chosen = left & ~pruning, left, []
        while len(chosen) < max_conditions:
            here = grow & inside
            p0, all0 = (here & bad).bit_count(), here.bit_count()
            if not p0 or p0 == all0:
                break
            base, best = math.log2(p0 / all0), None
            for test, mask in tests:
                both = here & mask
                p = (both & bad).bit_count()
                if p < min_cover:
                    continue
                gain = p * (math.log2(p / both.bit_count()) - base)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, test, mask)
            if best is None:
                break
            chosen.append(best[1:])
            inside &= best[2]
        if not chosen:
            break

        def worth(parts: list, at: int = left) -> float:
            for _, mask in parts:
                at &= mask
            at &= pruning
            p = (at & bad).bit_count()
            return (2 * p - at.bit_count()) / max(1, at.bit_count())

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        covered = left
        for _, mask in chosen:
            covered &= mask
        size = covered.bit_count()
        precision = (covered & bad).bit_count() / max(1, size)
        if size < min_cover or precision < min_precision:
            break
        out.append(Rule(tuple(t for t, _ in chosen), precision, size))
        left &= ~covered
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **learner) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled documents, picked by a hash of the id.

    The picked ids (bounded, so broadcast) meet the documents before any
    statistics are computed: only their texts are looked at. Rows that the base
    rules fail are left out: the list only decides about the others. Ids may be
    of any type.
    """
    picked = (
        labels.select("doc_id", "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    mine = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    seen = (
        text_statistics(mine, keep=("doc_id", "quality"))
        .where(~F.col("base_failed"))
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(*FEATURES)).alias("f"), F.first(F.xxhash64("doc_id")).alias("h"))
    )
    rows = sorted(seen.collect(), key=lambda r: (r["h"], str(r["doc_id"])))
    return learn_rules([(r["f"].asDict(), r["quality"] <= 0) for r in rows], **learner)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of every row, the rule that fired and ``kept``."""
    judged = text_statistics(docs, keep=keep).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The documents that base rules and learned list keep, with their columns."""
    rules = fit(docs, labels, **fitting)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    kept = judge(whole, rules, keep=("_row",)).where("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
