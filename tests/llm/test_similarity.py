import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import similarity
from docquarry.llm.similarity import components, first_of_each, keep_one, link_groups, op6_jaccard_join
from tests.llm.data import PROSE, odd, rows, store, table, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(4)))) if len(w) >= 4 else frozenset([tuple(w)])


def want(docs):
    sets = [grams(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (a == b or (85 * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b))):
                top[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), lowest.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(docs, sets))]


def check(df, found):
    key = lambda r: [(x is not None, x) for x in r]
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, found), key=key) == sorted(want(docs), key=key)


def edited(text, edits, words):
    w = text.split()
    for _ in range(edits):
        w[random.randrange(len(w))] = random.choice(words)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    random.seed(14)
    words = [f"w{i}" for i in range(2000)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    base, other, line = prose(150), prose(60), prose(12)
    out = [base] + [edited(base, random.randrange(1, 9), words) for _ in range(70)]
    out += [other] * 5 + [edited(other, 1, words) for _ in range(12)]
    out += [f"{line}\n{prose(random.randrange(5, 120))}" for _ in range(40)]
    chain = prose(200)
    for _ in range(12):  # each like the one before, the ends not alike
        out.append(chain)
        chain = edited(chain, 3, words)
    for n in range(1, 8):
        out += [prose(n)] * 2
    near = base.split()
    out += [" ".join(near[:n]) for n in range(110, 150, 3)]
    return out


def test_against_all_pairs(spark, texts):
    ids = random.sample(range(10_000), len(texts))
    df = table(spark, texts, ids).repartition(5)
    check(df, link_groups(with_extra(df)).collect())


def test_small_slices_and_joined_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 300)
    monkeypatch.setattr(similarity, "SENT_IDS", 0)
    monkeypatch.setattr(similarity, "GROWTH", 2)
    df = table(spark, texts)
    check(df, link_groups(df).collect())


@pytest.mark.parametrize("bits", [2, 8])
def test_sets_that_share_their_first_hash_stay_apart(spark, texts, bits):
    df = table(spark, texts).repartition(3)
    check(df, link_groups(df, bits=bits).collect())


def test_one_large_group_is_spread_over_tasks(spark, texts, monkeypatch):
    monkeypatch.setattr(similarity, "TOGETHER", 3)
    df = table(spark, texts)
    check(df, link_groups(df).collect())


def test_first_of_each():
    keys, checks = np.array([5, 5, 4, 5, 4]), np.array([1, 2, 1, 1, 1])
    assert first_of_each(keys, checks).tolist() == [True, True, True, False, False]


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check(df, op6_jaccard_join(spark, store(df, tmp_path / "a")).collect())
    assert op6_jaccard_join(spark, store(table(spark, []), tmp_path / "b")).count() == 0
    check(table(spark, [None, ""]), op6_jaccard_join(spark, store(table(spark, [None, ""]), tmp_path / "c")).collect())


def test_query(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), op6_jaccard_join(spark, sf).collect())


def test_components(spark):
    random.seed(15)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(random.randrange(200, 260), random.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in nodes)


def test_a_near_miss_alone_repeats_no_row(spark):
    # 100 shingles of 4 words within 125: similarity 0.80
    words = [f"w{i}" for i in range(128)]
    found = link_groups(table(spark, [" ".join(words), " ".join(words[:103])])).collect()
    assert sorted(tuple(r) for r in found) == [(0, 125, 0), (1, 100, 1)]


def test_keep_one_keeps_the_same_rows_however_the_scans_are_split(spark, tmp_path):
    """Rows are numbered once; later reads under another split of the files meet the same numbers."""
    texts = [f"{PROSE} {i % 50} copy of text {i % 50}" for i in range(400)]
    df = table(spark, texts).withColumns({"_row": F.lit("mine"), "__row": F.lit("too")})
    df.repartition(8).write.parquet(f"{tmp_path}/t")
    kept = keep_one(spark.read.parquet(f"{tmp_path}/t"))
    found = []
    for most in ("100", "1000000", "5000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", most)
        found.append(rows(kept, "doc_id", "text", "_row", "__row"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == found[2]
    assert sorted(r[1] for r in found[0]) == sorted(set(texts)) and {r[2:] for r in found[0]} == {("mine", "too")}
