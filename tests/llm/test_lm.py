import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docquarry.llm import lm
from docquarry.llm.lm import discounts, expand, op10_kneser_ney, squeeze, summed
from tests.llm.data import odd, store, table, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = None


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class Plain:
    """The same model, written plainly with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = [*WORD.findall(lower(t)), END]
            self.words.update(w)
            self.pairs.update(zip([END, *w], w))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.ends = Counter(b for _, b in self.pairs)
        self.begins = defaultdict(list)
        for (a, _), c in self.pairs.items():
            self.begins[a].append(c)
        self.d = self.discounts(self.pairs.values())
        self.low_d = self.discounts(self.ends.values())
        self.low_taken = sum(self.low_d[min(c, 3)] for c in self.ends.values())
        self.taken = {a: sum(self.d[min(x, 3)] for x in self.begins[a]) for a in self.words}

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), k) for k in (1, 2, 3)]

    def low(self, b):
        types = len(self.pairs)
        taken = self.low_taken
        return max(self.ends[b] - self.low_d[min(self.ends[b], 3)], 0) / max(types, 1) + (taken / types if types else 1) / (self.v + 1)

    def p(self, a, b):
        if not self.words[a]:
            return self.low(b)
        c = self.pairs[a, b]
        taken = self.taken[a]
        return max(c - self.d[min(c, 3)], 0) / self.words[a] + taken / self.words[a] * self.low(b)

    def score(self, text):
        w = [*WORD.findall(lower(text)), END]
        base = sum(math.log10((self.words[x] + 1) / (self.n + 1 * (self.v + 1))) for x in w)
        return len(w), sum(self.words[x] > 0 for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip([END, *w], w))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(docs, found):
    model = Plain([t for i, t in docs if not held(i)])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    want = []
    for i, t in docs:
        n, known, base, score = model.score(t)
        want.append((i, held(i), n, known, model.n, base, score))
    got = sorted(map(tuple, found), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    return model


@pytest.fixture
def prose():
    random.seed(12)
    words = [f"w{i}" for i in range(300)] + ["The", "of", "AND"] * 60
    return [" ".join(random.choice(words) for _ in range(random.randrange(0, 90))) for _ in range(150)]


def test_against_plain_model(spark, tmp_path, prose, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 100)
    monkeypatch.setattr(lm, "HELD", 500)
    df = table(spark, prose).repartition(3)
    model = check([(r["doc_id"], r["text"]) for r in df.collect()], op10_kneser_ney(spark, store(df, tmp_path)).collect())
    for a in [END, "w1", "the", "nowhere"]:
        total = sum(model.p(a, b) for b in model.words) + model.p(a, "nowhere")
        assert abs(total - 1) < 1e-9


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = op10_kneser_ney(spark, sf).collect()
    check(docs, found)
    held_out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check(df.select("doc_id", "text").collect(), op10_kneser_ney(spark, store(with_extra(df), tmp_path / "a")).collect())
    assert op10_kneser_ney(spark, store(table(spark, []), tmp_path / "b")).count() == 0
    only = op10_kneser_ney(spark, store(table(spark, [None, ""], [0, 1]), tmp_path / "c")).collect()
    check([(0, None), (1, "")], only)


def test_one_first_word_is_spread_over_buckets(spark):
    rows = spark.createDataFrame([([x for k in range(40) for x in (7, 1000 + i * 40 + k)] + [99],) for i in range(200)], "tokens array<long>")
    model = lm.train_model(rows, buckets=16)
    sizes = list(model.pair_sizes.values())
    assert sum(sizes) == model.types and max(sizes) < 2 * model.types / 16


def test_arrays():
    random.seed(13)
    for n in (0, 1, 1000):
        x = np.array([random.getrandbits(random.choice([1, 8, 30, 64])) for _ in range(n)], np.uint64)
        assert (expand(squeeze(x)) == x).all()
    keys, sums = summed(np.array([3, 1, 3], np.uint64), np.array([1, 2, 4], np.uint64))
    assert keys.tolist() == [1, 3] and sums.tolist() == [2, 5]
    assert discounts([0, 1, 1, 1]) == [0.5, 1.0, 1.5]
