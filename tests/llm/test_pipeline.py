import public_tokenizers
from test_models import containment
from test_rules_and_secrets import base, spans
from test_simhash import jaccard_classes

import corpus_pipeline as p
from lectern.llm import bpe, quality_rules, queries, secret_scan


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_in_turn(spark, docs, sf):
    assert len(p.STAGES) == 5
    now, sizes = docs, [docs.count()]
    for k, (_, f) in enumerate(p.STAGES):
        now = f(spark, now, sf).cache()
        sizes.append(now.count())
        assert k == 4 or now.columns == docs.columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0
    whole = sorted((r["doc_id"], r["n_tokens"]) for r in p.run(spark, sf).collect())
    assert whole == sorted((r["doc_id"], r["n_tokens"]) for r in now.collect())


def test_odd_tables(spark, odd, empty, sf):
    for df in (odd("x"), empty):
        for k, (_, f) in enumerate(p.STAGES):
            out = f(spark, df, sf)
            assert k == 4 or out.columns == df.columns
            assert out.count() <= df.count()


def test_stages_against_brute_force(spark, docs, sf):
    """Each stage on all that its predecessor kept, beside a plain version of it."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rules = quality_rules.fit(docs, labels)
    stats = {r["doc_id"]: r.asDict() for r in quality_rules.text_statistics(docs).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = [
        k
        for k, r in sorted(rows.items())
        if not base(r["text"])["base_failed"] and not any(all(c.holds(stats[k][c.feature]) for c in rule.conditions) for rule in rules)
    ]
    got = p.quality(spark, docs, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept

    label = jaccard_classes([rows[k]["text"] for k in kept])
    kept = sorted({kept[x] for x in label})
    got = p.near_dedup(spark, got, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept

    bad = {int(x[0]) for x in containment([rows[k] for k in kept], items)}
    kept = [k for k in kept if k not in bad]
    got = p.decontaminate(spark, got, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept

    scanned = {r["doc_id"]: r["spans"] for r in secret_scan.scan(got).collect()}
    got = p.redact_secrets(spark, got, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert sorted(texts) == kept
    for k in kept:
        found = [x for x in scanned[k].split(",") if x]
        assert set(spans(rows[k]["text"])) <= set(found)
        want, at = "", 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in found):
            if a >= at:
                want += rows[k]["text"][at:a] + "[SECRET]"
            at = max(at, b)
        assert texts[k] == want + rows[k]["text"][at:]

    plain = bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: bytes(r["ids"]) for r in p.encode(spark, got, sf).collect()} == {k: plain.encode(t) for k, t in texts.items()}
    got.unpersist()
