import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docquarry.llm import runs
from docquarry.llm.runs import find_runs, op13_periodic_runs, periodic_runs, primitive
from tests.llm.data import odd, rows, store, table, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, times=3):
    """(start, end, period) of the runs, each period tried at each place."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q, q))
            i = j + 1
    return sorted(found)


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    drop = {i for a, b, q in found for i in range(a + q, b)}
    listed = sorted((a, b - a, q) for a, b, q in found)
    best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if listed else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(listed), *best, best[1] * 1000 // best[2] if listed else None,
        sha("".join(f"{a},{n},{q}\n" for a, n, q in listed)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


CONTRACT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_words(rng):
    """Words with runs in runs: powers of powers, Fibonacci words, cut anywhere, with changes strewn in."""
    kind, k = rng.randrange(6), rng.randrange(1, 4)
    if kind == 0:
        w = [rng.randrange(k + 1) for _ in range(rng.randrange(300))]
    elif kind == 1:
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
        w = b[rng.randrange(50):][: rng.randrange(60, 350)]
    else:
        w = [rng.randrange(k + 1) for _ in range(rng.randrange(1, 25))]
        for _ in range(rng.randrange(1, 4)):
            more = [rng.randrange(k + 1) for _ in range(rng.randrange(6))]
            w = (w * rng.randrange(2, 12) + more)[: rng.randrange(20, 400)]
        w = w * rng.randrange(1, 5)
    w = w[: 600]
    for _ in range(rng.choice([0, 0, 1, 3])):
        if w:
            w[rng.randrange(len(w))] = rng.randrange(9)
    return [rng.randrange(50) for _ in range(rng.randrange(20))] + w + [rng.randrange(50) for _ in range(rng.randrange(20))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_trying_every_period(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(60)]
    found = find_runs(np.array([x for t in texts for x in t], np.int64), [len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [(at + a, at + b, q) for a, b, q in plain_runs(t)]
        at += len(t)
    assert found == sorted(want) and len(want) > 50


@pytest.mark.parametrize("period", [15, 16, 17, 21, 22, 26, 27, 31, 32, 33, 63, 64, 85, 100, 127, 500, 1023, 1024])
def test_every_period_at_any_phase(period):
    """Just three periods of words, in which a third of each may be one word again and again."""
    rng = random.Random(period)
    for hot in (0, period // 3, period // 2, period - 2):
        for lead in (0, 1, period // 2):
            one = [1] * hot + [rng.randrange(5, 60) for _ in range(period - hot - 1)] + [2]
            text = [99] * 3 + list(range(100, 100 + lead)) + one * 3 + [98, 97]
            found = find_runs(np.array(text, np.int64), [len(text)])
            assert (3 + lead, 3 + lead + 3 * period, period) in found
            if period <= 127:
                assert found == plain_runs(text)


def test_primitive_against_trying_every_period():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 5)
        assert primitive(np.array(w)) == (not any(len(w) % p == 0 and w == w[:p] * (len(w) // p) for p in range(1, len(w))))


def test_one_run_over_a_very_long_text():
    words = np.tile(np.arange(70_001), 4)
    assert find_runs(words, [len(words)]) == [(0, len(words), 70_001)]
    assert find_runs(np.zeros(500_000, np.int64), [500_000]) == [(0, 500_000, 1)]
    assert find_runs(np.zeros(0, np.int64), []) == find_runs(np.zeros(0, np.int64), [0, 0]) == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = docs.where("n_chars < 6000")  # trying every period takes the square of a text's length
    found = rows(periodic_runs(small, edit=True), *CONTRACT)
    assert found == sorted(plain_row(r["doc_id"], r["text"]) for r in small.collect())
    assert any(r[1] for r in found) and any(not r[1] for r in found)
    every = op13_periodic_runs(spark, sf)
    assert every.count() == docs.count() and set(CONTRACT) <= set(every.columns)


def test_odd_rows(spark, tmp_path, monkeypatch):
    df = odd(spark)
    found = rows(op13_periodic_runs(spark, store(with_extra(df), tmp_path / "a")), *CONTRACT)
    short = [r for r in df.collect() if len(r["text"] or "") < 6000]
    want = [plain_row(r["doc_id"], r["text"]) for r in short]
    key = lambda r: [(x is not None, x) for x in r]
    assert len(found) == df.count() and all(x in found for x in want)
    again = rows(periodic_runs(with_extra(df.where("length(text) < 6000 OR text IS NULL")), edit=True), *CONTRACT)
    assert again == sorted(want, key=key)
    assert op13_periodic_runs(spark, store(table(spark, []), tmp_path / "b")).count() == 0


def test_slices_do_not_matter(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b " * 40, None, "", "x y z " * 20 + "end", " \n", "one"])
    whole = list(runs.summaries(list(range(6)), texts, True))
    parts = [row for i in range(6) for row in runs.summaries([i], texts[i: i + 1], True)]
    assert whole == parts
