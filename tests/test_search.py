import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import answer as A
from lectern.operators import search as S
from lectern.operators.embedding import HashingEmbedder, embedded
from lectern.options import SearchOptions

TEXTS = ["the cat sat on the mat", "the dog sat", "a bird flew over the dog and the cat", "", "fish swim", "the the the"]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(f"chunk_{k}", k, t) for k, t in enumerate(TEXTS)], "chunk_id string, pos long, text string")
    return S.build_index(df, HashingEmbedder(64))


def bm25(query, k1=1.5, b=0.75, eps=0.25):
    docs = [t.lower().split() for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split()))
    return out


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_with_fill(spark, index):
    asked = ("the dog dog", "nothing known", "fish bird cat", "")
    got = S.lexical(index, queries(spark, *asked), SearchOptions(), 4).collect()
    for k, q in enumerate(asked):
        scores = bm25(q)
        want = sorted(range(len(TEXTS)), key=lambda i: -scores[i])[:4]
        mine = sorted((r["rank"], r["pos"], r["score"]) for r in got if r["query_id"] == k)
        assert [p for _, p, _ in mine] == want
        assert all(abs(s - scores[p]) < 1e-9 for _, p, s in mine)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(300, None)], "pos long, embedding array<double>").repartition(5)
    asked = df.where("pos < 7 or pos = 300").withColumnRenamed("pos", "query_id")
    for block in (2048, 3):
        got = S.vector_topk(df, asked, 5, block).collect()
        for q in range(7):
            want = np.argsort(-(m @ m[q]), kind="stable")[:5].tolist()
            assert [r["pos"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert S.vector_topk(df, asked.limit(0), 5).count() == 0
    assert S.vector_topk(df.limit(0), asked, 5).count() == 0


def test_rank_fusion(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id long, pos long, score double, rank int")
    got = S.fused_ranks(mk([(0, 5, 0.9, 1), (0, 6, 0.5, 2)]), mk([(0, 5, 3.0, 1), (0, 9, 1.0, 2)])).orderBy("ord").collect()
    assert [(r["pos"], round(r["score"], 6)) for r in got] == [(5, 0.075), (6, round(1 / 21, 6)), (9, round(1 / 41, 6))]


def test_combining_scores(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id long, pos long, score double, rank int")
    got = {r["pos"]: r["score"] for r in S.combined(mk([(0, 1, 0.9, 1), (0, 2, 0.5, 2)]), mk([(0, 2, 0.0, 1), (0, 3, 0.0, 2)])).collect()}
    assert got == pytest.approx({1: 0.6, 2: 0.6 * 0.5 / 0.9, 3: 0.0})


def test_rerank_factor(spark):
    rows = [(" ".join(["w"] * n), s) for n, s in ((9, 0), (10, 0), (200, 0), (201, 0), (10, 1000))]
    df = spark.createDataFrame(rows, "t string, s int").coalesce(1)
    f = [round(r[0], 6) for r in df.select(S.rerank_factor(F.lit("w x"), F.col("t"), F.col("s"))).collect()]
    assert f == [round(1.1 * x, 6) for x in (0.77, 1.1, 1.1, 0.88)] + [1.1]


def test_strategies(spark, index):
    q = queries(spark, "the dog sat", "fish")
    for name in S.STRATEGIES:
        rows = S.search(index, q, name, SearchOptions(top_k=3)).collect()
        assert rows and {r["strategy"] for r in rows} == {"hybrid" if name in ("hybrid", "ensemble_parallel") else name}
        for k in (0, 1):
            ranks = sorted(r["rank"] for r in rows if r["query_id"] == k)
            assert ranks == list(range(1, len(ranks) + 1))
    assert {r["score"] for r in S.search(index, q, "anything").collect()} == {1.0}
    assert all(r["chunk_id"].startswith("merged_") for r in S.search(index, q, "ensemble").collect())
    with pytest.raises(ValueError):
        S.search(None, q)


def test_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = S.Index.load(spark, str(tmp_path), index.embedder)
    q = queries(spark, "the dog")
    assert S.search(again, q, "lexical").collect() == S.search(index, q, "lexical").collect()


def test_embedder(spark):
    e = HashingEmbedder(32)
    m = e.embed(["some words here", "some words here", "", "zzz"])
    assert m.shape == (4, 64) and abs(float(m[0] @ m[1]) - 2) < 1e-5 and not m[2].any()
    df = embedded(spark.createDataFrame([("a b",), (None,)], "text string"), e)
    assert [len(r["embedding"]) for r in df.collect()] == [64, 64]


def test_context_and_prompt(spark):
    rows = [(0, 2, "b. text"), (0, 1, "first"), (1, 1, "only")]
    got = {r[0]: r[1] for r in A.context(spark.createDataFrame(rows, "query_id long, rank int, content string")).collect()}
    assert got == {0: "[Chunk 1 - unknown]: first. [Chunk 2 - unknown]: b. text", 1: "[Chunk 1 - unknown]: only"}
    p = spark.range(1).select(A.prompt(F.lit("q {context}?"), F.lit("c {query}"), template="{query}|{api_response}|{context}")).first()[0]
    assert p == "q c {query}?||c {query}"


def generators():
    class Broken:
        def generate(self, prompt):
            raise RuntimeError("down")

    class Tooled:
        def generate(self, prompt):
            if "Tool result: 42" in prompt:
                return '{"answer": "done", "confidence_score": 1, "need_api": null}'
            return '{"answer": "", "need_api": {"type": "GET", "url": "u"}}'

    return Broken(), Tooled()


def test_generation(spark):
    prompts = spark.createDataFrame([(1, "p")], "query_id long, prompt string")
    broken, tooled = generators()
    assert A.generated(prompts, broken).first()["error"] == "RuntimeError: down"
    assert "done" in A.generated(prompts, tooled, tool=lambda need: "42").first()["response"]
    assert "done" not in A.generated(prompts, tooled).first()["response"]


def test_answers(spark, index):
    got = {r["query_id"]: r for r in A.answers(index, queries(spark, "where is the bird?", "zebra unicorn"), "lexical").collect()}
    assert "bird" in got[0]["answer"].lower() and got[0]["confidence_score"] == 0.5
    assert got[1]["answer"] == A.NO_ANSWER
    broken = A.answers(index, queries(spark, "x"), "lexical", generators()[0]).first()
    assert broken["answer"].startswith("Processing error")
