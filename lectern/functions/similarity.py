"""Similarity of texts: expressions, and the plain forms that greedy operators need."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let

_TOKEN = re.compile(r"\w+")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays without repeats; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def contains_most(a: Column, b: Column, ratio: float = 0.85) -> Column:
    """The shorter text lies in the longer and is nearly as long."""
    short, long_ = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    fits = F.contains(long_, short) & (F.length(short) >= ratio * F.length(long_))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(False)).otherwise(fits)


def overlap(a: Column, b: Column, least: int = 5) -> Column:
    """Length of the longest end of ``a`` that begins ``b``; 0 if under ``least``."""

    def longest(n: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(least), n), lambda i: F.endswith(a, F.substring(b, F.lit(1), i)))
        return F.when(n >= least, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))

    return let(F.least(F.length(a), F.length(b)), longest)


def token_set(text: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(text.lower()))


def set_jaccard(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def as_similar(a: frozenset, b: frozenset, bound: float) -> bool:
    """Jaccard similarity of ``bound`` or more; sets of too different sizes are not compared."""
    small, large = sorted((len(a), len(b)))
    return small >= bound * large and set_jaccard(a, b) >= bound


def most_contained(a: str, b: str, ratio: float) -> bool:
    short, long_ = sorted((a, b), key=len)
    return bool(short) and len(short) >= ratio * len(long_) and short in long_


def end_overlap(a: str, b: str, least: int) -> int:
    """As :func:`overlap`: the beginning of ``b`` is looked up in the end of ``a``, longest overlap first."""
    least = max(1, least)
    at, tries = max(0, len(a) - len(b)), 0
    while (at := a.find(b[:least], at)) >= 0 and len(b) >= least:
        if b.startswith(a[at:]):
            return len(a) - at
        at, tries = at + 1, tries + 1
        if tries == 64:
            return _prefix_overlap(a[at:], b, least)
    return 0


def _prefix_overlap(a: str, b: str, least: int) -> int:
    """The same in linear time, for repetitive texts: the prefix function of ``b`` run over ``a``."""
    b = b[: len(a)]
    n = len(b)
    back, k = [0] * n, 0
    for i in range(1, n):
        while k and b[i] != b[k]:
            k = back[k - 1]
        k += b[i] == b[k]
        back[i] = k
    k = 0
    for ch in a:
        while k and (k == n or b[k] != ch):
            k = back[k - 1]
        k += b[k] == ch
    return k if k >= least else 0


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer text."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: best match among shared words and shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if shared and not (only_x and only_y):
        return 100.0
    s, sx, sy = " ".join(shared), " ".join(shared + only_x), " ".join(shared + only_y)
    best = indel_ratio(sx, sy)
    if shared:
        best = max(best, 200.0 * len(s) / (len(s) + len(sx)), 200.0 * len(s) / (len(s) + len(sy)))
    return best
