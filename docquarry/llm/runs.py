"""Maximal periodic runs of words in a text, by string synchronising sets at dyadic scales.

At scale Q, a power of two, periods from Q to 2 Q - 1 are sought. Of every window of Q / 2 + 1 positions
the one whose next Q / 2 words have the smallest hash is chosen if it stands at either end; so a position
is chosen by the Q words from it on, and equal words choose equal positions. Positions whose words repeat
with a period of a sixth of Q or less are left out; such regions are runs found at smaller scales, and
their last positions are chosen instead. Two chosen positions with equal words after them, and none such
between, propose their distance as a period; the stretch around them is then compared word by word.

Why none is missed: let a run from b have the smallest period q and 3 q words. If the positions from b to
b + Q - 1 aren't all left out, one of the first Q / 2 is chosen, and so is the one q later. If they are,
a region of a smaller period covers them; two periods can't agree on p + q words, so it ends within the
run, its last position is chosen, and so is the one q later. Words compared after a position are at least
q, so a third occurrence between the two would give the run a smaller period; and they are few enough to
lie within the run: hence three lengths of context, each for a third of the scale's periods. Periods below
the first scale are found by comparing all words that far apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.lm import mixed
from docquarry.llm.pieces import slices

#: The first scale; smaller periods are found directly.
FIRST = 16
#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: Bytes of text that a worker takes at once; a longer text by itself, at some 150 bytes a word.
SLICE_BYTES = 1_000_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = "start long, length long, period long"


def stretches(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last of each row of consecutive numbers in ascending ``where``."""
    if not len(where):
        return where, where
    new = np.flatnonzero(np.diff(where) != 1)
    return where[np.concatenate(([0], new + 1))], where[np.concatenate((new, [len(where) - 1]))] + 1


def primitive(words: np.ndarray) -> bool:
    """Whether the words are no repetition of fewer words."""
    n, rest, prime = len(words), len(words), 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            step = n // prime
            if np.array_equal(words[step:], words[:-step]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def small_periods(text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of periods below FIRST that have three periods and FIRST / 2 words."""
    found = []
    for q in range(1, FIRST):
        first, past = stretches(np.flatnonzero(text[q:] == text[:-q]))
        long = past - first + q >= max(TIMES * q, FIRST // 2)
        for a, b in zip(first[long].tolist(), past[long].tolist()):
            if primitive(text[a: a + q]):
                found.append((a, b + q, q))
    return found


def after(values: np.ndarray, by: int, fill: np.ndarray | np.uint64) -> np.ndarray:
    """The values moved ``by`` places to the front."""
    moved = np.empty_like(values)
    cut = max(len(values) - by, 0)
    moved[:cut] = values[by:]
    moved[cut:] = fill[cut:] if isinstance(fill, np.ndarray) else fill
    return moved


def repeated_regions(runs: list[tuple[int, int, int]], width: int, size: int) -> np.ndarray | None:
    """The positions whose next ``width`` words lie in a run of a period of a third of that at most."""
    inside = [(a, b) for a, b, q in runs if TIMES * q <= width <= b - a]
    if not inside:
        return None
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, [a for a, _ in inside], 1)
    np.add.at(steps, [b - width + 1 for _, b in inside], -1)
    return np.cumsum(steps[:-1]) > 0


def chosen_positions(names: np.ndarray, width: int, region: np.ndarray | None) -> np.ndarray:
    """The synchronising positions: by smallest name in a window of ``width`` + 1, and the ends of regions."""
    if region is not None:
        names = np.where(region, NONE, names)
    least, size = names, 1
    while size < width:
        least = np.minimum(least, after(least, size, NONE))
        size *= 2
    other = after(names, width, NONE)
    least = np.minimum(least, other)
    chosen = ((least == names) | (least == other)) & (least != NONE)
    if region is not None:
        chosen[:-1] |= region[:-1] & ~region[1:]
    return np.flatnonzero(chosen)


def equal_pairs(positions: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next neighbours among the ascending positions that have one name."""
    order = np.argsort(names, kind="stable")
    same = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    return positions[order[same]], positions[order[same + 1]]


def extended(text: np.ndarray, a: int, b: int, q: int) -> tuple[int, int]:
    """The stretch a .. b of words that equal the word q later, as long as it goes on to both sides."""
    step = 64
    while b + q < len(text):
        here, there = text[b: b + step], text[b + q: b + q + step]
        differ = np.flatnonzero(here[: len(there)] != there)
        b += int(differ[0]) if len(differ) else len(there)
        if len(differ):
            break
        step *= 2
    step = 64
    while a > 0:
        low = max(a - step, 0)
        differ = np.flatnonzero(text[low:a] != text[low + q: a + q])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, step = low, step * 2
    return a, b


def proposed_runs(text: np.ndarray, first: np.ndarray, periods: np.ndarray, context: int) -> set[tuple[int, int, int]]:
    """The runs around proposals: words from ``first`` on, ``context`` of them, should equal those a period later."""
    order = np.lexsort((first, periods))
    first, periods = first[order], periods[order]
    new = np.flatnonzero((np.diff(periods) != 0) | (np.diff(first) > context))
    starts, ends = first[np.concatenate(([0], new + 1))], first[np.concatenate((new, [len(first) - 1]))] + context
    runs = set()
    for a, b, q in zip(starts.tolist(), ends.tolist(), periods[np.concatenate(([0], new + 1))].tolist()):
        a, b = extended(text, a, b, q)
        if b - a >= (TIMES - 1) * q and np.array_equal(text[a:b], text[a + q: b + q]) and primitive(text[a: a + q]):
            runs.add((a, b + q, q))
    return runs


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of all texts, by place among all words.

    ``words``: numbers of 0 and more, one text after the other; ``sizes``: how many each text has. A run
    lies in one text, has LEAST words and TIMES periods at least, and can't be longer to either side.
    """
    sizes = np.asarray(sizes, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    # a mark of its own behind each text, so that no stretch goes on into the next
    text = np.empty(len(words) + len(sizes), np.int64)
    text[np.arange(len(words)) + rows] = words
    text[np.cumsum(sizes + 1) - 1] = -1 - np.arange(len(sizes))
    home = np.cumsum(sizes) - sizes  # of each text left, the place of its first word among all words
    runs = small_periods(text)
    all_runs = located(runs, sizes, home)
    names, scale = mixed(text.astype(np.uint64)), 1
    tail = mixed(np.arange(len(text), dtype=np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    q = FIRST
    while len(sizes) and sizes.max() >= TIMES * q:
        half = q // 2
        while scale < half:
            names, scale = mixed(names * np.uint64(0x9E3779B97F4A7C15) + after(names, scale, tail)), scale * 2
        left = sizes >= TIMES * q
        if 4 * sizes[left].sum() < 3 * len(text):
            cells = np.repeat(left, sizes + 1)
            moved = np.cumsum(cells) - 1
            runs = [(int(moved[a]), int(moved[b - 1]) + 1, p) for a, b, p in runs if cells[a]]
            text, names, tail, sizes, home = text[cells], names[cells], tail[cells], sizes[left], home[left]
        at = chosen_positions(names, half, repeated_regions(runs, half, len(text)))
        longer = mixed(names * np.uint64(0x9E3779B97F4A7C15) + after(names, half, tail))
        low, new = q, set()
        for context in (-(-4 * q // 3), -(-5 * q // 3), 2 * q - 1):
            late = np.minimum(at + (context - q), len(text) - 1)
            here, there = equal_pairs(at, mixed(longer[at] * np.uint64(0xD6E8FEB86659FD93) + longer[late]))
            apart = there - here
            fits = (apart >= low) & (apart <= context)
            if fits.any():
                new |= proposed_runs(text, here[fits], apart[fits], context)
            near = apart < 2 * q  # a longer context is equal only where the shorter one is
            at, low = np.union1d(here[near], there[near]), context + 1
        runs += sorted(new)
        all_runs += located(sorted(new), sizes, home)
        q *= 2
    return sorted(all_runs)


def located(runs: list[tuple[int, int, int]], sizes: np.ndarray, home: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs that are long enough, by place among all words."""
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    kept = [r for r in runs if r[1] - r[0] >= max(LEAST, TIMES * r[2])]
    rows = np.searchsorted(begins, [r[0] for r in kept], "right") - 1
    return [(int(a - begins[d] + home[d]), int(b - begins[d] + home[d]), q) for (a, b, q), d in zip(kept, rows)]


def repeated_words(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a text of the query is made to repeat itself, if it is."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    a = g % n
    return None if rest else (a, 1 + (n - a) // (3 + g % 8))


OUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and how many each has."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    full = pc.greater(pc.binary_length(trimmed), 0)
    lists = pc.ascii_split_whitespace(trimmed.filter(full))
    sizes = np.zeros(len(texts), np.int64)
    sizes[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), sizes


def summaries(doc_ids: list[int | None], texts: pa.Array, edit: bool) -> Iterator[tuple]:
    """A row of OUT for each text."""
    words, sizes = split_words(texts)
    begins = np.cumsum(sizes) - sizes
    source = np.arange(len(words))
    if edit:
        for doc_id, n, at in zip(doc_ids, sizes.tolist(), begins.tolist()):
            if change := repeated_words(doc_id, n):
                a, p = change
                source[at + a: at + n] = at + a + np.arange(n - a) % p
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    runs = find_runs(codes[source], sizes)
    kept = np.ones(len(words), bool)
    for a, b, q in runs:
        kept[a + q: b] = False
    counts = np.add.reduceat(np.concatenate((kept, [False])).astype(np.int64), begins) * (sizes > 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(source[kept])))
    joined = pc.binary_join(lists, " ")
    offsets, text = np.frombuffer(joined.buffers()[1], np.int32), memoryview(joined.buffers()[2] or b"")
    of = np.searchsorted(begins + sizes, [a for a, _, _ in runs], "right").tolist()
    by_row: dict[int, list[tuple[int, int, int]]] = {}
    for d, (a, b, q) in zip(of, runs):
        by_row.setdefault(d, []).append((int(a - begins[d]), b - a, q))
    for d, doc_id in enumerate(doc_ids):
        mine = by_row.get(d, [])
        best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        ledger = "".join(f"{a},{length},{q}\n" for a, length, q in sorted(mine, key=lambda r: (r[0], r[2])))
        yield (
            doc_id, len(mine), *best, best[1] * 1000 // best[2] if mine else None, hashlib.sha256(ledger.encode()).hexdigest(),
            hashlib.sha256(text[offsets[d]: offsets[d + 1]]).hexdigest(), int(sizes[d]), int(sizes[d] - counts[d]),
        )


def periodic_runs(documents: DataFrame, edit: bool = False) -> DataFrame:
    """A row of OUT for every row of documents (doc_id, text); other columns are ignored, no rows give none.

    Words are what white space (space, tab to carriage return) parts; a null, empty or blank text has
    none and no run. ``start``, ``length``, ``period`` and ``exponent_milli`` tell of the run with the
    most periods, of equals the one that begins first, then the shorter period; all runs are in
    ``runs_sha256``. ``collapsed_sha256`` digests the words that are left when each run keeps its first
    period, joined by blanks. Each text by itself and whole, no shuffle; repeated rows and ids give a
    row each. ``edit`` first makes a part of the texts repeat themselves, as the query asks (a null
    doc_id isn't chosen). Words are compared as they are; hashes of 64 bits propose periods only.
    """
    names = [c.strip().split(" ")[0] for c in OUT.split(",")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_BYTES):
                rows = list(summaries(batch.column("doc_id")[a:b].to_pylist(), texts[a:b], edit))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of them made to repeat themselves."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=True)
