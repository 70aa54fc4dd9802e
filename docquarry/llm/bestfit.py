"""Best-fit packing improved by local search: documents move and change places until bins are empty.

A group's pieces are put best-fit into bins. Then the emptiest bin is taken apart: each of its pieces
moves into the fullest bin with room, or changes places with one or two smaller ones elsewhere, so that
what the bin holds gets less and a fuller bin gets fuller. Each step makes the sum of squared fills
larger, so the search ends.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import stage
from docquarry.llm.packing import cut_pieces

#: Documents in a group, on average.
GROUP = 8192
SEED = 23
#: A bin with at least a part in so many of its room free is taken apart and packed anew with other groups'.
OPEN = 64
#: The search ends after so many bins in a row that could not be emptied.
TRIES = 32


class Bins:
    """Bins of one group of pieces, by the pieces' lengths; the search works on those of one room."""

    def __init__(self, lengths: np.ndarray, room: int):
        self.lengths, self.room = lengths.tolist(), room
        self.fill: list[int] = []
        self.held: list[list[tuple[int, int]]] = []  # per bin (length, piece), ascending
        self.spare: list[tuple[int, int]] = []  # (room left, bin) of every bin with any, ascending

    def put(self, piece: int, place: int) -> None:
        length = self.lengths[piece]
        self._spared(place, self.fill[place], self.fill[place] + length)
        insort(self.held[place], (length, piece))

    def take(self, piece: int, place: int) -> None:
        length = self.lengths[piece]
        self._spared(place, self.fill[place], self.fill[place] - length)
        held = self.held[place]
        del held[bisect_left(held, (length, piece))]

    def _spared(self, place: int, before: int, after: int) -> None:
        if 0 < before < self.room:
            del self.spare[bisect_left(self.spare, (self.room - before, place))]
        if 0 < after < self.room:
            insort(self.spare, (self.room - after, place))
        self.fill[place] = after

    def tightest(self, length: int, but: int = -1) -> int | None:
        """The fullest bin with room for the length; an empty one is none."""
        for at in range(bisect_left(self.spare, (length, -1)), len(self.spare)):
            if self.spare[at][1] != but:
                return self.spare[at][1]
        return None

    def best_fit(self) -> None:
        """The longest first, each into the bin it fills best, or a new one."""
        for piece in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            place = self.tightest(self.lengths[piece])
            if place is None:
                place = len(self.fill)
                self.fill.append(0)
                self.held.append([])
            self.put(piece, place)

    def swap(self, out: list[int], at: int, into: list[int], place: int) -> None:
        """Pieces ``out`` of bin ``at`` go to bin ``place``, pieces ``into`` of that one to the first."""
        for piece in out:
            self.take(piece, at)
        for piece in into:
            self.take(piece, place)
            self.put(piece, at)
        for piece in out:
            self.put(piece, place)

    def exchange(self, at: int) -> bool:
        """One change that moves length from bin ``at`` to another, no emptier bin: the one that moves most.

        A piece goes for a smaller one, for two that are smaller together, or two go for one. Bins
        whose spare room is no more than the best gain so far can't do better and are left out.
        """
        best, chosen = 0, None
        mine = self.held[at]
        two = list({a + b: [p, q] for i, (a, p) in enumerate(mine[:64]) for b, q in mine[:i]}.items())
        offers = [(length, [piece]) for length, piece in dict(mine).items()]
        for spare, place in reversed(self.spare):
            if spare <= best:
                break
            if place == at or self.fill[place] < self.fill[at]:
                continue
            theirs = self.held[place]
            for length, out in [*offers, *two]:
                # the smallest that leaves no overfull bin
                k = bisect_left(theirs, (max(length - spare, 1), -1))
                if k < len(theirs) and length - theirs[k][0] > best:
                    best, chosen = length - theirs[k][0], (out, [theirs[k][1]], place)
            for length, out in offers:
                found = two_of(theirs, length - spare, length - best)
                if found:
                    best, chosen = length - found[0], (out, found[1], place)
            if best == spare:
                break
        if chosen:
            self.swap(chosen[0], at, chosen[1], chosen[2])
        return chosen is not None

    def search(self) -> None:
        """Takes the emptiest bins apart, one after the other, until none can be or no bin can be saved."""
        least, used = fewest(self.lengths, self.room), sum(f > 0 for f in self.fill)
        stuck: set[int] = set()
        tries = 0
        while used > least and tries < TRIES:
            at = next((place for _, place in reversed(self.spare) if place not in stuck), None)
            if at is None:
                return
            before = self.fill[at]
            self.empty(at)
            if not self.fill[at]:
                used, tries = used - 1, 0
            else:
                tries += 1
            if self.fill[at] < before:
                stuck.clear()  # what was changed may help the others
            if self.fill[at]:
                stuck.add(at)

    def empty(self, at: int) -> None:
        """Moves out what fits elsewhere and exchanges the rest, while that helps."""
        while self.held[at]:
            moved = False
            for length, piece in reversed(self.held[at][:]):
                place = self.tightest(length, at)
                if place is not None and self.fill[place] >= self.fill[at] - length:
                    self.take(piece, at)
                    self.put(piece, place)
                    moved = True
            if self.held[at] and not moved and not self.exchange(at):
                return

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its bin, counted without the empty ones, and its offset."""
        bins, offsets = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64)
        for number, held in enumerate(h for h in self.held if h):
            at = 0
            for length, piece in reversed(held):
                bins[piece], offsets[piece] = number, at
                at += length
        return bins, offsets


def fewest(lengths: list[int], room: int) -> int:
    """A number of bins that no packing goes below: by the sum, and by pieces of which only k fit one bin."""
    bounds = [-(-sum(lengths) // room)]
    for k in range(1, 9):
        bounds.append(-(-sum(length * (k + 1) > room for length in lengths) // k))
    return max(bounds)


def two_of(held: list[tuple[int, int]], least: int, below: int) -> tuple[int, list[int]] | None:
    """The two pieces with the smallest sum of lengths from ``least`` up, if that is under ``below``."""
    low, high, found = 0, len(held) - 1, None
    while low < high:
        both = held[low][0] + held[high][0]
        if both < least:
            low += 1
            continue
        if both < below:
            below, found = both, (both, [held[low][1], held[high][1]])
        high -= 1
    return found


def pack_group(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin, from 0, and its offset. Pieces of the whole room need no search."""
    lengths = np.asarray(lengths, np.int64)
    part = np.flatnonzero(lengths < room)
    whole = np.flatnonzero(lengths >= room)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[whole] = np.arange(len(whole))
    found = Bins(lengths[part], room)
    found.best_fit()
    found.search()
    numbers, offsets[part] = found.places()
    bins[part] = numbers + len(whole)
    return bins, offsets


def pack_round(pieces: DataFrame, room: int, groups: int, number: int) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and ``_open``: whether their bin has much room left."""
    key = F.pmod(F.xxhash64(F.lit(SEED + number), "_row", "start"), F.lit(groups).cast("long"))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    high = number << 56

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "start"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = pack_group(lengths, room)
        fill = np.bincount(bins, lengths, minlength=1)
        return pdf.drop(columns=["_group"]).assign(
            sequence_id=high + (int(key[0]) << 24) + bins, offset=offsets, _open=(room - fill[bins]) * OPEN >= room
        )

    schema = ", ".join([*names, "sequence_id long", "offset long", "_open boolean"])
    return pieces.withColumn("_group", key).groupBy("_group").applyInPandas(pack, schema)


def pack_best(pieces: DataFrame, room: int, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, in as few sequences of ``room`` as the search finds.

    Pieces fall into groups at random, by a hash of their row and start; each is packed in one task of
    bounded size, whatever is frequent. The bins that stay open, about one a group, are taken apart and
    their pieces packed anew in groups of their own, until one group is left or a round closes too few.
    ``pieces`` (see packing.PIECES, and ``_row``) should be stored. No rows give none.
    """
    closed, number = [], 0
    count = pieces.count()
    while True:
        groups = max(1, -(-count // group))
        packed = stage(pack_round(pieces, room, groups, number), "packed")
        rest = packed.where("_open")
        left = rest.count()
        if groups == 1 or 4 * left > 3 * count:
            closed.append(packed)
            break
        closed.append(packed.where("NOT _open"))
        pieces, count, number = rest.select(*pieces.columns), left, number + 1
    whole = closed[0]
    for more in closed[1:]:
        whole = whole.unionByName(more)
    return whole.drop("_open")


def pack_tightly(documents: DataFrame, room: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents (doc_id, text) in sequences of at most ``room`` tokens, in as few as the search finds.

    Only a document longer than a sequence is cut, all its pieces but the last full. Null, empty and
    blank texts are the end id alone. Rows with null or equal doc_id are documents of their own. Other
    columns are ignored, no rows give none. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.
    """
    import public_tokenizers

    pieces = stage(cut_pieces(documents, public_tokenizers.path("word_bpe_49k.json"), room, end_id), "pieces")
    return pack_best(pieces, room).select(
        "doc_id", F.floor(F.col("start") / room).cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_tightly(spark.read.parquet(f"{sf_dir}/documents.parquet"))
