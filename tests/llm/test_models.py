import math
import zlib
from collections import Counter

import numpy as np

from lectern.llm import decontamination as d
from lectern.llm import lm_mixing as m


def split(r):
    return zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0


def brute(rows):
    counts = Counter()
    for r in rows:
        if not split(r):
            counts.update((r["text"] or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        tokens = [*(r["text"] or "").encode().lower().split(), b""]
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((str(r["doc_id"]), split(r), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(score, 5)))
    return sorted(out)


def test_base_scores(docs, odd):
    for df, head in ((docs, 100_000), (docs, 50), (odd("c"), 3)):
        got = m.score_documents(df, head).collect()
        cols = ("held_out", "n_tokens", "n_known", "train_tokens")
        assert sorted((str(r["doc_id"]), *[r[c] for c in cols], round(r["base_score"], 5)) for r in got) == brute(df.collect())
        assert all(r["score"] < 0 for r in got)


def test_empty(empty):
    assert m.score_documents(empty).count() == 0


def test_model_beats_chance_on_held_out_texts(docs):
    got = [r for r in m.score_documents(docs).collect() if r["held_out"] and r["n_tokens"] > 50]
    assert got and np.median([r["bits_per_byte"] for r in got]) < 3.2


def test_codes_are_a_tree():
    for counts in (np.ones(256, int), np.arange(256), 2 ** np.minimum(np.arange(256), 60)):
        lengths = m.code_lengths(counts)
        assert sum(2.0 ** -int(n) for n in lengths) == 1 and lengths.max() <= 40
        codes = [format(int(c), "b")[1:] for c in m.codes_of(lengths)]
        assert [len(c) for c in codes] == lengths.tolist()
        assert not any(b.startswith(a) for a, b in zip(sorted(codes), sorted(codes)[1:]))


class Slow:
    """The model, byte after byte and text after text, on whole numbers and single floats."""

    def __init__(self, texts):
        pairs = np.zeros((256, 256), np.int64)
        for t in texts:
            for a, b in zip(b" " + t, t + b"\n"):
                pairs[a, b] += 1
        self.codes = [[format(int(c), "b") for c in m.codes_of(m.code_lengths(row))] for row in pairs]
        self.tables = [Counter() for _ in m.TABLE_BITS]
        for t in texts:
            for _, slots, turn in self.bits(t):
                for table, s in zip(self.tables, slots):
                    table[s, turn] += 1

    @staticmethod
    def mixed(x):
        x = x * 0x9E3779B1 & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x85EBCA77 & 0xFFFFFFFF
        return x ^ x >> 13

    def bits(self, text):
        text, word, power, before = text + b"\n", 0, 1, 0
        for at, byte in enumerate(text):
            last = [text[at - k] if at >= k else 0 for k in range(1, 6)]
            near = last[0] | last[1] << 8 | last[2] << 16
            far = (near | last[3] << 24) * 0xC2B2AE3D + last[4] * 0x27D4EB2F
            salts = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
            contexts = [self.mixed(x + s & 0xFFFFFFFF) for x, s in zip((near, far, word + self.mixed(before)), salts)]
            code = self.codes[text[at - 1] if at else 32][byte]
            for k in range(1, len(code)):
                slots = []
                for c, bits in zip(contexts, m.TABLE_BITS):
                    run = 1 + (k - 1) // 4 * 4
                    h = c + int(code[:run], 2) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                    slots.append((h * 0x85EBCA77 & 0xFFFFFFFF) >> 36 - bits << 4 | int("1" + code[run:k], 2))
                yield at, slots, int(code[k])
            word, power = (word + (byte + 1) * power) & 0xFFFFFFFF, power * 0x01000193 & 0xFFFFFFFF
            if byte == 32:
                before, word, power = word, 0, 1

    def judged(self, table, slot):
        zero, one = table[slot, 0], table[slot, 1]
        odds = min(10.0, max(-10.0, math.log((one + 0.05) / (zero + 0.05))))
        n = zero + one
        return round((odds + 10) * 800) / 800 - 10, (n > 0) + (n > 2) + (n > 20)

    def score(self, text):
        weights, pace, bend = {}, {}, {}
        total, ends, now = 0.0, 64, []
        for at, slots, turn in [*self.bits(text), (None, None, None)]:
            if at is None or at >= ends:
                for cell in {x[0] for x in now}:
                    mine = [x for x in now if x[0] == cell]
                    for k in range(3):
                        slope = sum((x[2] - x[3]) * x[1][k] for x in mine) / len(mine)
                        pace[cell, k] = pace.get((cell, k), 1e-4) + slope**2
                        weights[cell, k] = weights.get((cell, k), 0.4) + 0.1 * slope / math.sqrt(pace[cell, k])
                for step in {x[4] for x in now}:
                    mine = [x for x in now if x[4] == step]
                    bend[step] = bend.get(step, 0.0) + sum(x[2] - x[3] for x in mine) / (len(mine) + 20)
                now = []
                ends = ends * 2 if ends < 4096 else ends + 4096
            if at is None:
                return total
            odds = [self.judged(t, s) for t, s in zip(self.tables, slots)]
            cell = odds[1][1] * 4 + odds[2][1]
            x = max(-11.99, min(11.99, sum(weights.get((cell, k), 0.4) * odds[k][0] for k in range(3))))
            step = int(x + 12)
            p = 1 / (1 + math.exp(-x - bend.get(step, 0.0)))
            total += math.log10(max(1e-6, p if turn else 1 - p))
            now.append((cell, [o for o, _ in odds], turn, p, step))


def test_scores_against_brute_force(spark, docs, odd):
    """Also: a score is the same however the rows are dealt, and long texts are learned and scored whole."""
    some = docs.where("doc_id % 3 = 0").select("doc_id", "text")
    more = spark.createDataFrame([(9001, "long tail of words " * 700), (9002, "x" * 30_000), (9003, ""), (None, None)], some.schema)
    for df in (some.unionByName(more), odd("score")):
        rows = df.collect()
        slow = Slow([m.spelled(m.words_of(r["text"])) for r in rows if not split(r)])
        for dealt in (df.repartition(3), df.coalesce(1)):
            for r in m.score_documents(dealt).collect():
                texts = [x["text"] for x in rows if x["doc_id"] == r["doc_id"]]
                want = slow.score(m.spelled(m.words_of(texts[0])))
                assert abs(r["score"] - want) <= 1e-4 * abs(want) + 1e-3


def test_no_training_documents(spark):
    ids = [k for k in range(200) if m.held_out(k)][:3]
    got = m.score_documents(spark.createDataFrame([(k, "some words") for k in ids], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 0 and abs(r["bits_per_byte"] - 8) < 1e-6 for r in got)


def test_score_depends_on_the_order_of_words(spark):
    """Contexts cross blanks and hold the word before, so a shuffled text is less likely."""
    phrase = "the quick brown fox jumps over the lazy dog while seven small birds sing above old stones".split()
    mixed = phrase[::2] + phrase[1::2][::-1]
    texts = [" ".join(phrase * 5)] * 40 + [" ".join(mixed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in m.score_documents(df.union(spark.createDataFrame([(99, " ".join(phrase))], df.schema))).collect()}
    assert abs(rows[40]["base_score"] - rows[99]["base_score"]) < 1e-9
    assert rows[99]["score"] > rows[40]["score"] + 1


def test_texts_are_scored_apart():
    rng = np.random.default_rng(3)
    texts = [m.spelled([b"w%d" % k for k in rng.integers(0, 300, n)]) for n in (0, 1, 5, 80, 2_000, 9_000)]
    raw = np.frombuffer(b" " + b"".join(texts) + b"\n", np.uint8).astype(int)
    model = m.Model(m.Trees(np.bincount(raw[:-1] * 256 + raw[1:], minlength=1 << 16)), [rng.integers(0, 64_000, 1 << b).astype(np.uint16) for b in m.TABLE_BITS])
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts], rtol=1e-12)


def containment(docs, items):
    out = []
    for it in items:
        w = d.words_of(it["text"])
        n = min(5, len(w))
        if not n:
            continue
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for r in docs:
            v = d.words_of(r["text"])
            both = len(mine & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)})
            if both >= 0.8 * len(mine):
                out.append((str(r["doc_id"]), it["item_id"], both, len(mine)))
    return sorted(out)


def test_contained_items(spark, docs, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd_items = spark.createDataFrame([(1, "A b, C! d"), (2, "word7 word8"), (3, ""), (4, None), (5, "same same same same same"), (5, "same same same same same")], "item_id long, text string")
    for df, items in ((docs, bench), (odd("item_id"), odd_items), (docs, odd_items)):
        want = containment(df.collect(), items.collect())
        for most in (500_000, 40):
            got = d.contained_items(df, items, max_shingles=most)
            assert sorted((str(r["doc_id"]), r["item_id"], r["shared"], r["n_shingles"]) for r in got.collect()) == want
        kept = d.drop_contaminated(df, items).collect()
        bad = {x[0] for x in want}
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r["doc_id"]) for r in df.collect() if str(r["doc_id"]) not in bad)
    assert d.contained_items(empty, bench).count() == 0
    assert d.contained_items(docs, bench.limit(0)).count() == 0


def test_short_item_in_a_long_document(spark):
    item = " ".join(f"needle{k}" for k in range(37))
    hay = [f"h{k}" for k in range(20_000)]
    cut = item.split()
    cut[20] = "changed"
    rows = [(1, " ".join(hay[:9_000] + item.split() + hay[9_000:])), (2, " ".join(hay)), (3, " ".join(hay[:77] + cut + hay[77:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["containment"] for r in d.contained_items(docs, items).collect()}
    assert got == {1: 1.0, 3: 28 / 33}


def test_repetitive_and_scattered_items(spark):
    """Few distinct shingles in a long item, an item whose shingles a document holds in any order, crowds of items with one shingle."""
    rng = np.random.default_rng(2)
    items, docs = [], []
    for k in range(60):
        period = [f"p{k}x{i}" for i in range(3 + k % 9)]
        item = (period * 80)[: 150 + k]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([f"w{x}" for x in rng.integers(0, 10**6, 900)] + item + [f"w{x}" for x in rng.integers(0, 10**6, 900)])))
    whole = [f"q{i}" for i in range(200)]
    items.append((100, " ".join(whole)))
    pieces = [whole[k : k + 40] for k in range(0, 200, 36)]
    docs.append((100, " ".join(" ".join([*p, *[f"z{k}y{i}" for i in range(700)]]) for k, p in enumerate(pieces[::-1]))))
    items += [(200 + k, f"which of the following is true {k} or {k + 1} then") for k in range(300)]
    docs.append((200, "which of the following is true"))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = containment(a.collect(), b.collect())
    assert len(want) >= 61
    got = d.contained_items(a, b)
    assert sorted((str(r["doc_id"]), r["item_id"], r["shared"], r["n_shingles"]) for r in got.collect()) == want


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor " * 400_000 + "sit amet one two three four five six seven"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "dolor lorem ipsum dolor lorem ipsum dolor")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in d.contained_items(docs, items).collect()} == {(1, 1, 3), (1, 2, 3)}


def test_item_beside_a_repeated_word_is_found(spark):
    """A passage of 52 of 65 shingles beside a single word over and over, whichever hash that word has."""
    items, docs = [], []
    words = [f"q{i}" for i in range(69)]
    items.append((0, " ".join(words)))
    for k in range(400):
        docs.append((k, " ".join([f"filler{k}"] * (200 + k % 65) + words[:56] + [f"filler{k}"] * 400)))
    items = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert d.contained_items(df, items).count() == 400


class _Asked:
    """Takes the place of a table and keeps the first function that it is given."""

    run = None

    def mapInArrow(self, run, schema):
        self.run = self.run or run
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_counting_bits_takes_little_memory(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0})()))
    trees = m.Trees(np.ones(1 << 16, np.int64))
    texts = [" ".join(f"w{(k * 7919 + j * j) % 50021}é" for j in range(400)) for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

    def counted(**more):
        docs = _Asked()
        m.bit_counts(docs, trees, **more)
        total = {}
        for b in docs.run(iter([batch])):
            key = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            total[key] = total.get(key, 0) + int(m._unpacked(b.column(3)[0].as_py()).astype(np.int64).sum())
        return total

    tracemalloc.start()
    try:
        whole = counted()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 130e6, peak
    assert counted(most=1 << 21) == whole  # sent before the tables are full


def test_counting_and_scoring_cost_little(spark, monkeypatch):
    """CPU time beside that of sorting a number for every bit and table on the same machine; bits counted or summed one by one take over four times that."""
    import time

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0})()))
    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, 1 + k % 9)) for k in range(20_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 500), 20_000) - 1]) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    whole = [m.spelled(m.words_of(t)) for t in texts]
    pairs = np.zeros(1 << 16, np.int64)
    for t in whole:
        raw = np.frombuffer(b" " + t + b"\n", np.uint8).astype(np.int64)
        pairs += np.bincount(raw[:-1] * 256 + raw[1:], minlength=1 << 16)
    trees = m.Trees(pairs)
    n_bits = int((trees.lengths * pairs).sum())
    blocks = [rng.integers(0, 1 << 21, 1 << 19).astype(np.uint32) for _ in range(3 * n_bits >> 19)]
    docs = _Asked()
    m.bit_counts(docs, trees)
    model = m.Model(trees, [m.held_odds(rng.integers(0, 30, 2 << bits)) for bits in m.TABLE_BITS])

    def least(run):
        took = []
        for _ in range(3):
            begun = time.process_time()
            run()
            took.append(time.process_time() - begun)
        return min(took)

    sorting = least(lambda: [np.sort(x) for x in blocks])
    counting = least(lambda: [None for _ in docs.run(iter([batch]))])
    scoring = least(lambda: [model.score(x) for x in m._portions(iter(whole))])
    assert counting < 3.2 * sorting and scoring < 4.6 * sorting, (counting, scoring, sorting)


def test_words_of_many_texts():
    import pyarrow as pa

    texts = [None, "", " ", "\t\x0b\x0c a\x1cb  C d\x85 ", "É x\r\n\n y", "   lead", "trail  ", "\x00 z\x1f"]
    for kind in (pa.string(), pa.large_string()):
        words = m._words(pa.array(texts, kind))
        assert m._spelled(words) == [m.spelled(m.words_of(t)) for t in texts]
        tokens, owner = m._tokens(words)
        assert sorted(zip(owner.tolist(), tokens.to_pylist())) == sorted((k, w) for k, t in enumerate(texts) for w in [*m.words_of(t), b""])
