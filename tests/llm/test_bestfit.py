import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm import bestfit
from docquarry.llm.bestfit import Bins, fewest, op11_best_fit_packing, pack_best, pack_group, two_of
from docquarry.llm.common import stage
from docquarry.llm.packing import cut_pieces
from tests.llm.data import odd, store, table, with_extra

FILE = public_tokenizers.path("word_bpe_49k.json")


def valid(lengths, bins, offsets, room):
    held = defaultdict(list)
    for length, b, o in zip(lengths, bins, offsets):
        held[int(b)].append((int(o), int(length)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
    assert sorted(held) == list(range(len(held)))
    return len(held)


def optimum(lengths, room):
    """The fewest bins, by trying all ways; for a few lengths."""
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        first, *others = rest
        for i in range(len(bins)):
            if bins[i] + first <= room and bins[i] not in bins[:i]:
                go(others, [*bins[:i], bins[i] + first, *bins[i + 1:]])
        go(others, [*bins, first])

    go(sorted(lengths, reverse=True), [])
    return best


def test_few_pieces_against_all_ways():
    rng = random.Random(4)
    over = 0
    for _ in range(150):
        room = rng.choice([10, 30, 100])
        lengths = [rng.randrange(1, room + 1) for _ in range(rng.randrange(0, 10))]
        bins, offsets = pack_group(np.array(lengths, np.int64), room)
        over += valid(lengths, bins, offsets, room) - optimum(lengths, room)
    assert 0 <= over <= 3


def test_search_saves_bins_that_best_fit_uses():
    """Triples that fill a bin exactly; best-fit puts them together wrongly."""
    rng = random.Random(5)
    plain = found = least = 0
    for _ in range(12):
        lengths = []
        for _ in range(60):
            a, b = rng.randrange(250, 480), rng.randrange(250, 480)
            lengths += [a, b, 1000 - a - b]
        lengths = [x for x in lengths if x > 0]
        first = Bins(np.array(lengths), 1000)
        first.best_fit()
        squares = sum(f * f for f in first.fill)
        plain += len(first.fill)
        bins, offsets = pack_group(np.array(lengths), 1000)
        found += valid(lengths, bins, offsets, 1000)
        assert sum(f * f for f in np.bincount(bins, lengths)) >= squares
        least += fewest(lengths, 1000)
    assert least <= found < plain


def test_exchanges():
    """A move, one for one, two for one and one for two, each of which empties a bin."""
    for lengths, room, want in (
        ([6, 4, 5, 3, 2], 10, 2), ([7, 2, 6, 3, 2], 10, 2), ([50, 30, 20, 45, 35, 20], 100, 2), ([8, 8, 8], 24, 1),
    ):
        bins, offsets = pack_group(np.array(lengths), room)
        assert valid(lengths, bins, offsets, room) == want
    b = Bins(np.array([6, 3, 5, 2]), 10)
    b.fill, b.held = [0, 0], [[], []]
    for piece, place in ((0, 0), (1, 0), (2, 1), (3, 1)):
        b.put(piece, place)
    assert b.exchange(1) and sorted(b.fill) == [6, 10]


def test_two_of_against_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        held = sorted((rng.randrange(1, 20), i) for i in range(rng.randrange(0, 8)))
        least, below = rng.randrange(0, 30), rng.randrange(0, 40)
        sums = [a + b for i, (a, _) in enumerate(held) for b, _ in held[:i] if least <= a + b < below]
        found = two_of(held, least, below)
        assert (found[0] if found else None) == (min(sums) if sums else None)


def test_bounds():
    assert fewest([], 10) == 0 and fewest([6, 6, 6], 10) == 3 and fewest([4, 4, 4, 4], 10) == 2 and fewest([3] * 10, 10) == 4


def check(docs, found, room=4096):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    want, got = defaultdict(int), defaultdict(int)
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), room):
            piece = ids[at: at + room]
            want[doc_id, at // room, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    for r in found:
        got[tuple(r)[:5]] += 1
    assert got == want
    numbers = {s: i for i, s in enumerate(sorted({r["sequence_id"] for r in found}))}
    n = valid([r["length"] for r in found], [numbers[r["sequence_id"]] for r in found], [r["offset"] for r in found], room)
    return n, -(-sum(r["length"] for r in found) // room)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n, least = check(docs, op11_best_fit_packing(spark, sf).collect())
    assert least <= n <= least + 1


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check(df.select("doc_id", "text").collect(), op11_best_fit_packing(spark, store(with_extra(df), tmp_path / "a")).collect())
    assert op11_best_fit_packing(spark, store(table(spark, []), tmp_path / "b")).count() == 0


@pytest.mark.parametrize("group", [16, 64])
def test_open_bins_of_all_groups_are_packed_together(spark, group):
    rng = random.Random(8)
    df = table(spark, [" ".join(["word"] * rng.randrange(1, 40)) for _ in range(600)], [None] * 300 + [7] * 300)
    pieces = stage(cut_pieces(df, FILE, 64, 1), "pieces")
    packed = pack_best(pieces, 64, group).collect()
    numbers = {s: i for i, s in enumerate({r["sequence_id"] for r in packed})}
    n = valid([r["length"] for r in packed], [numbers[r["sequence_id"]] for r in packed], [r["offset"] for r in packed], 64)
    assert len(packed) == pieces.count() and n <= 1.03 * sum(r["length"] for r in packed) / 64 + 1
    assert len({r["sequence_id"] >> 56 for r in packed}) > 1


def test_groups_of_lengths_that_do_not_fit_together_end_soon():
    assert valid([2100] * 8000, *pack_group(np.full(8000, 2100), 4096), 4096) == 8000
    mixed = np.array([1400] * 3000 + [2049] * 3000 + [1366] * 1000)
    assert valid(mixed, *pack_group(mixed, 4096), 4096) >= fewest(mixed.tolist(), 4096)
    assert bestfit.TRIES < 100
