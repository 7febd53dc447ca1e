import re

from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.operators import neardup as N
from lectern.options import ChunkOptions
from lectern.plans import engine


def spec_pack(pieces, limit, mark, carry, move):
    out, now, start = [], [], 0
    for p in pieces:
        n = len(p.split())
        if now and sum(len(x.split()) for x in now) + n > limit:
            out.append((mark.join(now), start, start + sum(len(x.split()) for x in now)))
            now = carry(now)
            start += move(now, n)
            now = [*now, p]
        else:
            now = [*now, p]
    return [*out, (mark.join(now), start, start + sum(len(x.split()) for x in now))] if now else out


def sentences(t):
    return [x.strip() for x in re.split("[.!?]+", t) if x.strip()]


def chunks(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = C.exploded(df, expr, "doc_id").orderBy("doc_id", "chunk_pos").collect()
    return [[(r["text"], r["start_idx"], r["end_idx"]) for r in got if r["doc_id"] == k] for k in range(len(texts))]


def words(n, w="w"):
    return " ".join([w] * n)


def test_sentences(spark):
    df = spark.createDataFrame([("a. b. c.",), ("?!",), (None,)], "t string")
    assert [r[0] for r in df.select(C.sentences(F.col("t"))).collect()] == [["a", "b", "c"], [], []]


def test_semantic_overlap(spark):
    t = f"{words(300, 'a')}. {words(200, 'b')}. {words(100, 'c')}."
    got = chunks(spark, [t, words(700), ""], C.semantic_chunks(F.col("text")))
    assert got[0] == [(f"{words(300, 'a')} {words(200, 'b')}", 0, 500), (f"{words(300, 'a')} {words(200, 'b')} {words(100, 'c')}", 20, 620)]
    assert got[1] == [(words(700), 0, 700)] and got[2] == []


def test_folds_against_spec(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [spec_pack(sentences(t), 512, " ", lambda a: a[-2:], lambda a, n: 10 * len(a)) for t in texts]
    assert chunks(spark, texts, C.semantic_chunks(F.col("text"))) == want
    doubled = [t.replace("\n", "\n\n") for t in texts]
    want = [spec_pack([x.strip() for x in t.split("\n\n") if x.strip()], 768, "\n\n", lambda a: [], lambda a, n: n) for t in doubled]
    assert chunks(spark, doubled, C.hierarchical_chunks(F.col("text"))) == want


def test_paragraphs_and_windows(spark):
    three = "\n\n".join(words(400, x) for x in "abc")
    got = chunks(spark, [three], C.hierarchical_chunks(F.col("text")))[0]
    assert [(s, e) for _, s, e in got] == [(0, 400), (400, 800), (800, 1200)]
    got = chunks(spark, [words(500), "", words(462), words(463)], C.fixed_chunks(F.col("text")))
    assert [[(s, e) for _, s, e in x] for x in got] == [[(0, 500), (462, 500)], [], [(0, 462)], [(0, 463), (462, 463)]]


def test_windows_are_added_below_three(spark):
    got = chunks(spark, ["one. two.", "\n\n".join(words(700, x) for x in "abc")], C.raw_chunks(F.col("text")))
    assert len(got[0]) == 3 and len(got[1]) == 4


def test_resize(spark):
    raw = C.semantic_chunks(F.col("text"))
    got = chunks(spark, [words(1100), words(512)], C.resized(raw))
    assert [len(x[0].split()) for x in got[0]] == [512, 512, 76] and len(got[1]) == 1


def spec_dedup(texts):
    def tokens(t):
        return set(re.findall(r"\w+", t.lower()))

    def inside(a, b):
        s, t = (a, b) if len(a) < len(b) else (b, a)
        return bool(a and b) and s in t and len(s) / len(t) >= 0.85

    def like(a, b):
        x, y = tokens(a), tokens(b)
        return (len(x & y) / len(x | y) if x | y else 1.0) >= 0.85

    return tokens, inside, like


def spec_merge(texts):
    _, inside, like = spec_dedup(texts)

    def lap(a, b):
        return next((i for i in range(min(len(a), len(b)), 4, -1) if a.endswith(b[:i])), 0)

    again = True
    while again:
        again, out, gone = False, [], set()
        for i, m in enumerate(texts):
            if i in gone:
                continue
            for j in range(i + 1, len(texts)):
                t = texts[j]
                if j in gone:
                    continue
                if inside(m, t) or like(m, t):
                    m = t if len(t) > len(m) else m
                elif k := lap(m, t):
                    m += t[k:]
                elif k := lap(t, m):
                    m = t + m[k:]
                else:
                    continue
                gone.add(j)
                again = True
            out.append(m)
        texts = out
    return texts


def test_merge_against_spec(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for k in range(0, 60, 4):
        cut = [t[:300] for t in texts[k : k + 4]] + [texts[k][250:500], texts[k][100:320]]
        assert [t for t, _ in N.merged_texts(cut)] == spec_merge(cut)
    assert N.merged_texts(["hello world", "world peace"]) == [("hello world peace", 0.0)]


def test_greedy_unique():
    a = "one two three four five six seven eight nine ten"
    assert N.greedy_unique(["short", a, a.upper(), a + " eleven", "something else entirely here"]) == [3, 4]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = engine.chunked(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, parts in by.items():
        have = set(" ".join(parts).split())
        assert have <= set(texts[k].replace(".", " ").replace("!", " ").replace("?", " ").split()) | set(texts[k].split())
    assert {k for k, t in texts.items() if len(t.strip()) > 10} >= set(by)
    kept = engine.chunked(docs, keep_metadata=True).where("chunk_type is not null").count()
    assert kept == len(got)


def test_ingest_numbers_chunks(spark):
    docs = spark.createDataFrame([("b.txt", words(900)), ("a.md", "tiny text of a few words. Two."), ("c", " ")], "source string, text string")
    got = engine.ingested(docs, o=ChunkOptions(size=100, overlap=10)).orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == [f"chunk_{k}" for k in range(len(got))]
    assert got[0]["source"] == "a.md" and got[0]["file_type"] == ".md" and {r["source"] for r in got} == {"a.md", "b.txt"}
