import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from docquarry.llm.fingerprints import block_masks, fingerprints, near_fingerprints, op2_simhash
from tests.llm.data import odd, store, table, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(n, seed):
    """xxhash64 of one long, as Spark hashes it."""
    return xxhash.xxh64(struct.pack("<q", n), seed=seed).intdigest()


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def simhash(text):
    hashes = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall(text or "")]
    if not hashes:
        return 0
    votes, total = Counter(), 0
    for i in range(max(len(hashes) - 5, 0) + 1):
        h = 42
        for w in hashes[i:i + 5]:
            h = mix(w, h)
        total += 1
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


@pytest.fixture(scope="module")
def prose():
    words = [f"w{i}" for i in range(60)]
    random.seed(1)
    return [" ".join(random.choice(words) for _ in range(random.randrange(1, 80))) for _ in range(40)]


def check(docs, found):
    ids = sorted({-1 << 63 if i is None else i for i, _ in docs})
    near = {}
    by_id = {}
    for i, t in docs:
        by_id.setdefault(-1 << 63 if i is None else i, []).append(t or "")
    want = []
    for i, t in docs:
        t, own = t or "", -1 << 63 if i is None else i
        n = len(t)
        nxt = by_id[ids[ids.index(own) - 1]]
        # the smallest replacement of as much as the longest text of the id replaces
        most = max(len(x) for x in by_id[own]) // 3
        repl = min(x[:most] for x in nxt)[: n // 3]
        edited = t[: n - n // 3] + repl
        a, b = simhash(t), simhash(edited)
        c = min((simhash(x) for x in nxt), key=signed)
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        want.append((own, n, hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c)))
    got = [(-1 << 63 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:7]) for r in found]
    assert sorted(got) == sorted(want)
    prints = [simhash(t) for _, t in docs]
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] % 50 == 0:
            near = sum((int(r["fingerprint"], 16) ^ p).bit_count() <= 3 for p in prints) - 1
            assert r["n_near"] == near
        else:
            assert r["n_near"] is None


def test_against_plain_python(spark, tmp_path, prose):
    df = table(spark, prose + prose[:3], [i * 10 for i in range(43)])
    check([(r["doc_id"], r["text"]) for r in df.collect()], op2_simhash(spark, store(with_extra(df), tmp_path)).collect())


def test_partners_are_named(spark, tmp_path, prose):
    df = table(spark, prose + prose[:3] + prose[:1], [*range(0, 430, 10), None])
    found = op2_simhash(spark, store(df, tmp_path)).collect()
    classes = {}
    for r in found:
        classes.setdefault(r["fingerprint"], []).append(r["doc_id"])
    for r in found:
        if r["n_near"] is None:
            assert r["near"] is None
            continue
        a, want = int(r["fingerprint"], 16), []
        for f, ids in classes.items():
            n, distance = len(ids) - (f == r["fingerprint"]), (a ^ int(f, 16)).bit_count()
            if distance <= 3 and n:
                want.append((distance, f, min(i for i in ids if i is not None), n))
        assert [tuple(x) for x in r["near"]] == sorted(want) and sum(x[3] for x in want) == r["n_near"]
    assert {r["doc_id"]: [tuple(x)[2:] for x in r["near"] or []] for r in found}[0] == [(0, 2)]


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check([(r["doc_id"], r["text"]) for r in df.collect()], op2_simhash(spark, store(df, tmp_path)).collect())


def test_empty_and_one(spark, tmp_path):
    assert op2_simhash(spark, store(table(spark, []), tmp_path / "a")).count() == 0
    one = op2_simhash(spark, store(table(spark, ["a b c d e f"]), tmp_path / "b")).collect()[0]
    assert one["near_next"] == 1 and one["n_near"] == 0


def test_masks_cover_every_choice_of_bits():
    random.seed(2)
    for radius in (0, 1, 3, 5):
        masks = block_masks(radius)
        for _ in range(300):
            differ = sum(1 << b for b in random.sample(range(64), radius))
            assert any(differ & m == 0 for m in masks)


def test_search_finds_all(spark):
    random.seed(3)
    prints = [random.getrandbits(64) for _ in range(60)]
    for p in prints[:60]:
        for _ in range(6):
            prints.append(p ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 6))))
    df = spark.createDataFrame([(signed(p),) for p in prints] + [(None,)] + [(signed(prints[0]),)] * 50, "fingerprint long")
    asked = [signed(p) for p in prints[:20]]
    got = near_fingerprints(spark.createDataFrame([(p,) for p in asked], "fingerprint long"), df)
    want = {(a, signed(p), (a ^ signed(p)).bit_count() if a >= 0 and signed(p) >= 0 else bin((a ^ signed(p)) & (1 << 64) - 1).count("1"))
            for a in asked for p in prints if bin((a ^ signed(p)) & (1 << 64) - 1).count("1") <= 3}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_ties_vote_against(spark):
    df = spark.createDataFrame([("k", "a b c d e"), ("k", "a b c d e"), (None, None)], "key string, text string")
    got = {r["key"]: (r["fingerprint"], r["copies"]) for r in fingerprints(df, ["key"], "text").collect()}
    assert got["k"] == (signed(simhash("a b c d e")), 2) and got[None] == (0, 1)
