import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from docquarry.llm.common import balanced, feistel, numbered
from docquarry.llm.sharding import assign_shards, op4_feistel_shards, shard_documents, shuffled_position, walk_length
from tests.llm.data import odd, odd_texts, rows, store, table, with_extra


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 10, 1000, 4097):
        left, right = balanced(n)
        assert n <= left * right < n + max(left, 1) + 1
        got = [r[0] for r in spark.range(left * right).select(feistel(F.col("id"), left, right, "k")).collect()]
        assert sorted(got) == list(range(left * right))
    big = [r[0] for r in spark.range(50).select(feistel(F.col("id") + (1 << 61), 1 << 31, 1 << 31, "k")).collect()]
    assert len(set(big)) == 50 and all(0 <= x < 1 << 62 for x in big)


def test_walk_ends_below_the_total(spark):
    for n in (2, 3, 5, 11, 101, 1023, 1025):
        walk = walk_length(spark, n, "k")
        got = [r[0] for r in spark.range(n).select(shuffled_position(F.col("id"), n, "k", walk)).collect()]
        assert sorted(got) == list(range(n))


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 997, 1, 7).select(((F.col("id") * 31) % 100).alias("a"), "id")
    got, total = numbered(df, ["a"])
    found = sorted((r["_row"], r["a"]) for r in got.collect())
    assert total == 997 and [n for n, _ in found] == list(range(997))
    assert [a for _, a in found] == sorted(a for _, a in found)


def check(found, shards):
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows(spark):
    df = odd(spark)
    found = shard_documents(with_extra(df), 4).collect()
    assert len(found) == df.count()
    check(found, 4)
    texts = df.select("doc_id", "text").collect()
    want = sorted(((t or "").encode() for _, t in texts), key=len)
    assert sorted(r["size"] for r in found) == [len(t) + 16 for t in want]
    assert sorted(r["text_crc32"] for r in found) == sorted(zlib.crc32(t) for t in want)


def test_empty_and_one(spark):
    assert shard_documents(table(spark, []), 40).count() == 0
    one = shard_documents(table(spark, ["x"]), 40).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_reproducible_and_keyed(spark):
    df = table(spark, [f"text {i}" for i in range(500)])
    a = rows(shard_documents(df, 7), "doc_id", "shard", "slot")
    assert a == rows(shard_documents(df.repartition(5, "text"), 7), "doc_id", "shard", "slot")
    assert a != rows(shard_documents(df, 7, key="other"), "doc_id", "shard", "slot")


def test_a_third_of_equal_rows(spark):
    df = table(spark, ["same"] * 200 + [f"t{i}" for i in range(400)], [None] * 200 + list(range(400)))
    found = assign_shards(df, ["doc_id"], 9).collect()
    assert len(found) == 600
    check(found, 9)


def test_query(spark, sf):
    found = op4_feistel_shards(spark, sf).collect()
    assert len(found) == 200 and {r["law"] for r in found} == {"rows"}
    check(found, 40)


def test_query_on_odd_rows(spark, tmp_path):
    assert op4_feistel_shards(spark, store(odd(spark), tmp_path)).count() == len(odd_texts()) + 3
