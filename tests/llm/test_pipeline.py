"""The pipeline against its stages written plainly, stage by stage."""

import re

import corpus_pipeline
from tests.llm.data import odd, store, table
from tests.llm.test_packing import check as check_packing
from tests.llm.test_quality import measure
from tests.llm.test_similarity import want as linked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text):
    n, chars, symbols, dup, repeat = measure(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    capitals = sum(c.isupper() and re.match(r"[^\W\d_]", c) is not None for c in text)
    return not (
        n < 50 or 100 * repeat > 50 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > n
        or 100 * dup > 50 * lines or 2 * capitals > chars
    )


def run_stages(spark, docs, tmp_path):
    out = []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    return out


def check(spark, docs, tmp_path):
    kept, one, masked, packed = run_stages(spark, docs, tmp_path)
    assert kept.columns == one.columns == masked.columns == docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept_rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert sorted(map(str, kept_rows)) == sorted(str(r) for r in rows if good(r[1] or ""))
    groups = linked([(i, t) for i, (_, t) in enumerate(kept_rows)])
    one_rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    component = {}
    for i, (_, _, c) in enumerate(groups):
        component.setdefault(kept_rows[i], c)
    assert len(one_rows) == len({c for _, _, c in groups}) == len({component[r] for r in one_rows})
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in masked.collect():
        old = before[r["doc_id"]]
        for mail in re.findall(r"[\w.]+@[\w.]+\.com", old):
            assert mail not in r["text"]
        if not re.search(r"@|\d", old):
            assert r["text"] == old
    check_packing([tuple(r) for r in masked.select("doc_id", "text").collect()], packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect())
    return packed


def test_small_table(spark, sf, tmp_path):
    packed = check(spark, spark.read.parquet(f"{sf}/documents.parquet"), tmp_path)
    assert corpus_pipeline.run(spark, sf).count() == packed.count() > 0


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(store(odd(spark), tmp_path / "in") + "/documents.parquet")
    run_stages(spark, docs, tmp_path / "a")
    empty = spark.read.parquet(store(table(spark, []), tmp_path / "none") + "/documents.parquet")
    assert [d.count() for d in run_stages(spark, empty, tmp_path / "b")] == [0, 0, 0, 0]
