from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.operators import neardup as N

few = st.text("ab ", max_size=30)


def brute_overlap(a, b, least):
    return next((i for i in range(min(len(a), len(b)), least - 1, -1) if a.endswith(b[:i])), 0)


@given(few, few, st.integers(1, 6))
def test_overlap(a, b, least):
    assert S.end_overlap(a, b, least) == brute_overlap(a, b, least)


def test_long_repetitive_overlap():
    a, b = "ab" * 5000, "ab" * 4000 + "c"
    assert S.end_overlap("x" + "a" * 300 + "b", "a" * 200, 5) == 0
    assert S.end_overlap(a + "aab" * 900, "aab" * 800 + "z", 5) == 2400
    assert S.end_overlap(a, b, 5) == 8000


@given(few, few)
def test_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    assert S.common_subsequence(a, b) == row[-1]


@given(few, few)
def test_jaccard_is_symmetric(a, b):
    x, y = S.token_set(a), S.token_set(b)
    assert S.set_jaccard(x, y) == S.set_jaccard(y, x) and 0 <= S.set_jaccard(x, y) <= 1
    assert S.as_similar(x, y, 0.85) == (S.set_jaccard(x, y) >= 0.85)


def test_ratios():
    assert S.token_set_ratio("a b c", "c b a d") == 100.0
    assert S.token_set_ratio("", "a") == 0.0
    assert S.token_set_ratio("abc", "xyz") == 0.0
    assert N.fuzzy_unique(["new york mets", "new york mets vs braves", "other text"]) == ["new york mets vs braves", "other text"]


def test_expressions(spark):
    rows = [("hello world", "world peace"), ("x" * 85, "x" * 100), ("x" * 84, "x" * 100), ("", "a"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(S.overlap(F.col("a"), F.col("b")).alias("o"), S.contains_most(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["o"] for r in got] == [5, 85, 84, 0, 0]
    assert [r["c"] for r in got] == [False, True, False, False, True]
    assert df.select(S.overlap(F.col("a"), F.col("b"), 6)).first()[0] == 0
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>").coalesce(1)
    assert [round(r[0], 3) for r in sets.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.333]


def test_joins_on_a_small_table(spark):
    base = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [(1, base), (2, base), (3, base + " x"), (4, "quick " + base[4:]), (5, "ab"), (6, "abcdefgh"), (7, "abcdefg"), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {(r["id_a"], r["id_b"]) for r in N.jaccard_pairs(df).collect()}
    sets = {k: S.token_set(t or "") for k, t in rows}
    reps = [1, 3, 5, 6, 7]
    assert pairs == {(a, b) for a in reps for b in reps if a < b and sets[a] != sets[b] and S.set_jaccard(sets[a], sets[b]) >= 0.85}
    assert {tuple(r) for r in N.containment_pairs(df).collect()} == {(1, 3), (7, 6)}
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in N.exact_classes(df).collect()}
    assert got[2] == (1, 2) and got[9] == (8, 2)


def test_sets_do_not_travel_with_pairs(spark):
    """Near copies meet in pairs that grow with their square; what is shuffled grows with the copies."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _near_copies(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def _near_copies(spark):
    words = [f"w{k:05d}" for k in range(4000)]
    texts = {k: words[: 4000 - 4 * k] + [f"own{k}x{j}" for j in range(k % 7)] for k in range(120)} | {500: words[:2000], 501: ["w00001"], 502: []}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(store.executorList(True).apply(k).totalShuffleWrite() for k in range(store.executorList(True).size()))
    before = moved()
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in N.jaccard_pairs(df).collect()}
    assert moved() - before < 60e6, moved() - before
    sets = {k: frozenset(t) for k, t in texts.items() if t}
    want = {(a, b): S.set_jaccard(x, y) for a, x in sets.items() for b, y in sets.items() if a < b and S.set_jaccard(x, y) >= 0.85}
    assert got == want and len(want) > 7000
    cut = {(r["id_a"], r["id_b"]): r["jaccard"] for r in N.jaccard_pairs(df, room=500).collect()}
    assert cut == want
