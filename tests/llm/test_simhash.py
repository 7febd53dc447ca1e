import random

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash as s


def fingerprint(text, width=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(codes, radius):
    label = list(range(len(codes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def near_codes(n, seed):
    r = random.Random(seed)
    out = {0}
    while len(out) < n:
        c = r.choice(sorted(out)[:40]) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randrange(4)):
            c ^= 1 << r.randrange(64)
        out.add(c)
    return sorted(out)


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> k
    return x


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 16])
def test_index_finds_all_pairs(radius):
    codes = sorted(near_codes(400, radius), key=gray)
    groups = np.sort(np.array([c % 3 for c in range(len(codes))]))
    arr = np.array(codes, np.uint64)
    got = [(int(i), int(j)) for a, b in s.GrayIndex(arr, groups).pairs(radius, room=1000) for i, j in zip(a, b)]
    want = [
        (i, j)
        for i in range(len(codes))
        for j in range(i + 1, len(codes))
        if groups[i] == groups[j] and (codes[i] ^ codes[j]).bit_count() <= radius
    ]
    assert sorted(got) == want and len(set(got)) == len(got)


@pytest.mark.parametrize("room", [50_000, 20])
def test_links_and_components(spark, room):
    codes = near_codes(600, 7)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r["node"]: r["root"] for r in s.components(s.links(df, 2, room)).collect()}
    want = classes(codes, 2)
    by_root = {}
    for c, k in zip(signed, want):
        by_root.setdefault(k, set()).add(c)
    for group in by_root.values():
        assert {roots.get(c, c) for c in group} == {min(group)}


def test_query_against_brute_force(docs, odd, empty):
    for df in (docs, odd("fp")):
        rows = df.collect()
        codes = [fingerprint(r["text"]) for r in rows]
        label = classes(codes, 2)
        least = {}
        for r, k in zip(rows, label):
            if r["doc_id"] is not None:
                least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
        want = sorted((str(r["doc_id"]), f"{c:016x}", str(least.get(k))) for r, c, k in zip(rows, codes, label))
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in s.classes(df).collect())
        assert got == want
    assert s.classes(empty).count() == 0


def jaccard_classes(texts, width=5, bound=0.8):
    sets = [set(s.shingles_of(t, width)) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            both = len(sets[i] & sets[j])
            if same or both and both >= bound * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for k in range(60):
        t = [r.choice(words) for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(t))
        for _ in range(k % 4):
            c = list(t)
            for _ in range(len(c) // 120):
                c[r.randrange(len(c))] = "edit"
            texts.append(" ".join(c))
    texts += [texts[0], "", "", None, "short one", "short one"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    label = jaccard_classes(texts)
    want = {}
    for k, x in enumerate(label):
        want.setdefault(x, k)
    got = sorted(x["doc_id"] for x in s.near_duplicates(df, room=8).collect())
    assert got == sorted(want.values())


def test_near_duplicates_on_odd_tables(odd, empty):
    out = s.near_duplicates(odd("row"))
    assert out.columns == odd("row").columns
    assert sorted(str(x["doc_id"]) for x in out.collect()) == ["1", "3", "5", "6", "7", "8", "None"]
    assert s.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n, shared", [(200, 178), (60, 54)])
def test_signatures_of_similar_sets_meet(n, shared):
    """Pairs just over 0.8: none without a common route, none with under half of the signature's bytes."""
    rng = np.random.default_rng(5)
    lost = unlike = 0
    alike = []
    for _ in range(3000):
        h = rng.integers(0, 2**64, 2 * n - shared, np.uint64)
        a, b = s.signature(h[:n]), s.signature(h[n - shared :])
        lost += not (a[:8] == b[:8]).any()
        alike.append((a.astype(np.uint8) == b.astype(np.uint8)).sum())
        unlike += alike[-1] < 32
    similarity = shared / (2 * n - shared)
    assert lost == 0 and unlike == 0
    assert abs(np.mean(alike) - 64 * similarity) < 0.6 and np.std(alike) < 3.5


def test_repeated_passages_do_not_hide_near_duplicates(spark):
    """A short passage once and ten times: the shingle sets are nearly equal, the weighted fingerprints are not."""
    texts = []
    for k in range(80):
        body, passage = [f"b{k}x{i}" for i in range(104)], [f"p{k}x{i}" for i in range(6)]
        texts += [" ".join(body + passage), " ".join(body + passage * 10)]
    label = jaccard_classes(texts)
    assert len(set(label)) == 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in s.near_duplicates(df).collect()) == sorted(set(label))


def test_crowded_keys_are_split(spark):
    """600 differing near copies share keys: every pair meets, and no group is over the room by much."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[: (at := r.randrange(300))] + [f"e{k}"] + base[at + 1 :]) for k in range(600)]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    sketches = s._sketched(rows, 5, 8).cache()
    filed = s._suspects(sketches, 0.8, 24, 100).collect()
    sizes = {}
    for x in filed:
        sizes[x["k"]] = sizes.get(x["k"], 0) + 1
    assert max(sizes.values()) <= 160 and {x["row"] for x in filed} == set(range(600))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x["doc_id"] for x in s.near_duplicates(df, room=100).collect()] == [0]


def test_classes_where_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "one hot text that is copied" if k % 3 else f"text number {k} stands alone here") for k in range(600)] + [(None, None), (700, "")]
    got = {r["doc_id"]: r["component_id"] for r in s.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    codes = {k: fingerprint(t) for k, t in rows}
    ids = sorted((k for k in codes if k is not None))
    label = classes([codes[k] for k in ids], 2)
    assert {k: got[k] for k in ids} == {k: ids[x] for k, x in zip(ids, label)}
    assert got[None] == 700
