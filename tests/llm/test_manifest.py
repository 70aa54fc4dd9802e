import hashlib
import zlib

import pytest

from docquarry.llm import manifest
from docquarry.llm.manifest import merkle_manifest, op12_merkle_manifest
from tests.llm.data import odd, store, table, with_extra

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    texts = [None if v is None else str(v) for v in values]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i:i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def way(found, at):
    for level in found[:-1]:
        run = at // 16 * 16
        yield "".join(level[run:at]), "".join(level[at + 1:run + 16])
        at //= 16


def plain(docs):
    """doc_id, leaf, subroot, root, proof, folded root, verified of (doc_id, source, lang, n_chars, text) rows."""
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((d for d in docs if d[1] == s), key=lambda d: (first(d[0]), leaf(d))) for s in sources}
    trees = {s: levels([leaf(d) for d in members[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    rows = []
    for k, s in enumerate(sources):
        for i, d in enumerate(members[s]):
            path = [*way(trees[s], i), *way(top, k)]
            node = leaf(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                node = leaf([*d[:4], d[4].translate(SMALL)])
            for left, right in path:
                node = sha(left + node + right)
            root = top[-1][0]
            rows.append((d[0], leaf(d), trees[s][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return rows


def check(df, found):
    docs = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(docs), key=key)


def test_query(spark, sf):
    found = op12_merkle_manifest(spark, sf)
    check(spark.read.parquet(f"{sf}/documents.parquet"), found)
    assert not found.where("not verified").isEmpty() and not found.where("verified").isEmpty()


def test_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    df = odd(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source"))).withColumn("_at", F.lit("x"))
    check(df, op12_merkle_manifest(spark, store(with_extra(df), tmp_path / "a")))
    assert op12_merkle_manifest(spark, store(table(spark, []), tmp_path / "b")).count() == 0
    one = table(spark, ["Only One"])
    check(one, merkle_manifest(one))


@pytest.mark.parametrize("n", [15, 16, 17, 256, 257, 600])
def test_sizes_around_full_runs(spark, monkeypatch, n):
    """With blocks of 16 nodes, so that a tree has several rounds."""
    monkeypatch.setattr(manifest, "DEPTH", 1)
    df = table(spark, [f"Text {i}" for i in range(n)]).selectExpr("doc_id", "text", "lang", "'hot' AS source", "n_chars")
    few = table(spark, ["Aa", "Bb", "Cc"], [-1, -2, -3])
    check(df.union(few), merkle_manifest(df.union(few)))


def test_many_sources(spark):
    df = table(spark, [f"T{i}" for i in range(400)]).selectExpr(
        "doc_id", "text", "lang", "concat(if(doc_id % 2 = 0, 'ä', 'z'), cast(doc_id % 300 as string)) AS source", "n_chars")
    check(df, merkle_manifest(df))


def test_no_level_shows_a_change(spark):
    """Any change of a field, order of sources or number of rows gives another root."""
    base = [f"text {i}" for i in range(40)]
    roots = {merkle_manifest(table(spark, t)).first()["root"] for t in (base, [*base[:-1], "text x"], base[:-1], base[::-1])}
    assert len(roots) == 4
