import zlib
from collections import defaultdict

from lectern.llm import sharding


def check(df, n_shards=8, tolerance=0.001):
    rows = df.collect()
    got = sharding.assign_shards(df, n_shards, tolerance).collect()
    assert len(got) == len(rows)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(size.values()), max((r["size"] for r in got), default=0)
    for k in range(n_shards if rows else 0):
        assert abs(size[k] - total / n_shards) <= largest + 2 * tolerance * total / n_shards + 1
    return got


def test_documents(docs):
    got = check(docs)
    whole = defaultdict(set)
    for r in got:
        whole[r["text_crc32"]].add(r["shard"])
    assert sum(len(x) > 1 for x in whole.values()) <= 7  # only a splitter parts equal texts


def test_odd_and_empty(odd, empty):
    check(odd("shard"))
    check(empty)


def test_third_of_rows_with_one_text(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k} " + "x" * (k % 50)) for k in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_identical_rows_only(spark):
    for n, row in ((40, (1, "a")), (3000, (None, "same text"))):
        check(spark.createDataFrame([row] * n, "doc_id long, text string").repartition(5))


def test_keys_carry_over():
    top = (1 << 63) - 1
    assert sharding._next_key((3, 4), top + 1) == (3, 5, -(1 << 63))
    assert sharding._next_key((3, top), top + 1) == (4, -(1 << 63), -(1 << 63)) and sharding._next_key((), top + 1) is None


def test_written_columns_may_clash(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", "a", "b", "c", "d") for k in range(50)], "doc_id long, text string, shard string, shard_ string, tie string, salt string")
    sharding.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == ["doc_id", "salt", "shard", "shard_", "shard__", "text", "tie"]
    assert sorted((r["doc_id"], r["shard__"], r["shard_"], r["tie"], r["salt"]) for r in back.collect()) == [(k, "a", "b", "c", "d") for k in range(50)]


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.withColumnRenamed("lang", "hi"), f"{tmp_path}/out", 4, files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, 4).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want
