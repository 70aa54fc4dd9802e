"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Words are known by their 64-bit hash. A word's id is its place in the sorted array of all hashes, which
is cut into buckets by the hash's upper bits; a bigram is the number id(first) * V + id(second), and the
bigrams lie, sorted, in buckets too. Each bucket is a file or two in the folder all executors share,
written by one task under a temporary name and then renamed, so a task that runs again does no harm.
The folder must be one that workers can open (a mounted file system).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import ascii_lower, word_hashes
from docquarry.session import shared_path

#: Tokens that a worker takes at once; a longer text by itself.
SLICE = 1_000_000
#: Counts that a worker holds before it merges them.
HELD = 6_000_000
#: Files that a worker has mapped at a time.
MAPPED = 512


def tokens(text: Column) -> Column:
    """Hashes of the words, A-Z as small letters, then that of the end, which is no word."""
    return F.concat(word_hashes(ascii_lower(text)), F.array(F.xxhash64(F.lit(" "))))


def shared_folder(spark: SparkSession, name: str) -> str:
    place = urlparse(shared_path(spark, name))
    if place.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files: spark.checkpoint.dir must be a mounted folder, not {place.scheme}:")
    os.makedirs(place.path, exist_ok=True)
    return place.path


# --- arrays ---------------------------------------------------------------------------------------


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, small ones in few bytes: the bytes of equal rank together, compressed."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def write_array(path: str, numbers: np.ndarray) -> None:
    """In the narrowest type that holds them; the reader tells the type by the file's size."""
    top = int(numbers.max()) if len(numbers) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * np.dtype(k).itemsize)
    own = f"{path}.{uuid.uuid4().hex}"
    numbers.astype(kind).tofile(own)
    os.replace(own, path)


@lru_cache(maxsize=MAPPED)
def mapped(path: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u8")
    return np.memmap(path, f"<u{os.path.getsize(path) // n}", "r", shape=(n,))


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their tokens one after the other, and where each row's begin; every row has a token."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        ends = np.asarray(lists.offsets)
        start = 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, "right")) - 1)
            values = np.asarray(lists.values[int(ends[start]): int(ends[stop])]).view(np.uint64)
            yield batch.slice(start, stop - start), values, ends[start:stop] - ends[start]
            start = stop


class Counter:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.parts, self.held, self.merged = [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts.astype(np.uint64)))
        self.held += len(found)
        if self.held > self.merged + HELD:
            self.parts = [self.result()]
            self.merged = self.held = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return summed(*(np.concatenate(x) for x in zip(*self.parts)))


BLOBS = "bucket int, keys binary, counts binary"


def blobs(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its keys, as differences, and counts. ``keys`` sorted."""
    order = np.argsort(buckets, kind="stable")
    keys, counts, buckets = keys[order], counts[order], buckets[order]
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(keys) else np.zeros(0, int)
    last = [*first[1:], len(keys)]
    rows = [(int(buckets[a]), squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(counts[a:b])) for a, b in zip(first, last)]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])


def merged_blobs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(expand(k.as_py())) for k in table["keys"]]
    return summed(np.concatenate(keys), np.concatenate([expand(c.as_py()) for c in table["counts"]]))


# --- model ----------------------------------------------------------------------------------------


def discounts(n: list[int]) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and 3 or more, given how many counts are 1, 2, 3 and 4.

    Where a number is 0, as in very small corpora, the discounts are 0.5, 1 and 1.5.
    """
    if not all(n[:4]):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(int)], 0.0)


@dataclass
class Model:
    """Where the files are, and the numbers that belong to the whole model."""

    folder: str
    bits: int  # of a hash that make its word bucket
    sizes: list[int]  # words in each bucket
    tokens: int  # N
    pair_buckets: int
    pair_sizes: dict[int, int] = field(default_factory=dict)
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    types: int = 0  # different bigrams
    left: float = 1.0  # share of the lower order that goes to the uniform distribution

    def __post_init__(self):
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        self.words = int(self.offsets[-1])  # V
        if self.words > 1 << 32:
            raise ValueError("bigrams of more than 2^32 different words do not fit into 64 bits")

    def array(self, name: str, bucket: int) -> np.ndarray:
        return mapped(f"{self.folder}/{name}-{bucket}", self.sizes[bucket])

    def by_bucket(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """For sorted hashes the word buckets that they fall into."""
        buckets = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(keys) else []
        for a, b in zip(first, [*first[1:], len(keys)]):
            yield int(buckets[a]), slice(a, b)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """For sorted hashes their words' ids; -1 for unknown ones."""
        found = np.full(len(keys), -1, np.int64)
        for bucket, part in self.by_bucket(keys):
            if self.sizes[bucket]:
                have = self.array("hash", bucket)
                at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
                found[part] = np.where(have[at] == keys[part], at + self.offsets[bucket], -1)
        return found

    def of_ids(self, name: str, ids: np.ndarray) -> np.ndarray:
        """For sorted ids their words' numbers ``name``."""
        out = np.zeros(len(ids), np.int64)
        buckets = np.searchsorted(self.offsets, ids, "right") - 1
        for bucket in np.unique(buckets).tolist():
            a, b = np.searchsorted(ids, self.offsets[[bucket, bucket + 1]])
            out[a:b] = self.array(name, bucket)[ids[a:b] - self.offsets[bucket]]
        return out

    def pair_bucket(self, first: np.ndarray, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bigrams with one first word share a bucket, unless it is so frequent that it has several."""
        spread = (1 + count.astype(np.float64) * 4 * self.pair_buckets / max(self.tokens, 1)).astype(np.uint64)
        return ((mixed(first) + mixed(pair) % spread) % np.uint64(self.pair_buckets)).astype(np.int64)


def count_words(train: DataFrame, folder: str, buckets: int) -> Model:
    """First pass: the sorted hashes of all words and their counts."""
    bits = max(buckets - 1, 0).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for _, values, _ in token_slices(batches):
            counter.add(values)
        keys, counts = counter.result()
        yield blobs(keys, counts, keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, counts = merged_blobs(table)
        write_array(f"{folder}/hash-{bucket}", keys)
        write_array(f"{folder}/count-{bucket}", counts)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "size": [len(keys)], "tokens": [int(counts.sum())]})

    found = train.select("tokens").mapInArrow(count, BLOBS).groupBy("bucket").applyInArrow(write, "bucket int, size long, tokens long").collect()
    sizes = {r["bucket"]: r["size"] for r in found}
    return Model(folder, bits, [sizes.get(b, 0) for b in range(1 << bits)], sum(r["tokens"] for r in found), buckets)


def count_pairs(train: DataFrame, model: Model) -> Model:
    """Second pass: the sorted bigrams and their counts; for each word how many bigrams it begins, by count, and ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, size = Counter(), np.uint64(model.words)
        for _, values, _ in token_slices(batches):
            keys, at = np.unique(values, return_inverse=True)
            ids = model.ids(keys)[at].astype(np.uint64)
            # every text ends with the end, which is thus what the next one's first word follows
            counter.add(np.concatenate((ids[-1:], ids[:-1])) * size + ids)
        keys, counts = counter.result()
        first = keys // size
        words, at = np.unique(first, return_inverse=True)
        yield blobs(keys, counts, model.pair_bucket(first, keys, model.of_ids("count", words.astype(np.int64))[at]))

    stats = ["n1", "n2", "n3", "ends"]

    def write(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, counts = merged_blobs(table)
        write_array(f"{model.folder}/pair-{bucket}", keys)
        write_array(f"{model.folder}/times-{bucket}", counts)
        size = np.uint64(model.words)
        first, last = keys // size, keys % size
        one, none = np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64)
        by_count = [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]
        ids, *sums = summed(np.concatenate((first, last)), *(np.concatenate((b, none)) for b in by_count), np.concatenate((none, one)))
        ids = ids.astype(np.int64)
        word_bucket = np.searchsorted(model.offsets, ids, "right") - 1
        # the bucket's own numbers, as one more row
        own = [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
        columns = [np.append(word_bucket, -1 - bucket).astype(np.int32), np.append(ids, own[0])]
        columns += [np.append(s, n) for s, n in zip(sums, own[1:])]
        return pa.table(dict(zip(["word_bucket", "id", *stats], columns)))

    def write_stats(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        names = ["word_bucket", "size", "c1", "c2", "c3", "c4", "m3"]
        if bucket < 0:
            row = [table[c][0].as_py() for c in ["id", *stats]]
            return pa.table({n: pa.array([v], pa.int32() if n == "word_bucket" else pa.int64()) for n, v in zip(names, [bucket, *row, 0])})
        ids, *sums = summed(table["id"].to_numpy(), *(table[s].to_numpy() for s in stats))
        at = ids - model.offsets[bucket]
        for name, values in zip(stats, sums):
            full = np.zeros(model.sizes[bucket], np.int64)
            full[at] = values
            write_array(f"{model.folder}/{name}-{bucket}", full)
        ends = sums[3]
        row = [bucket, int(ends.sum()), *(int((ends == k).sum()) for k in (1, 2, 3, 4)), int((ends > 2).sum())]
        return pa.table({n: pa.array([v], pa.int32() if n == "word_bucket" else pa.int64()) for n, v in zip(names, row)})

    pairs = train.select("tokens").mapInArrow(count, BLOBS).groupBy("bucket").applyInArrow(
        write, "word_bucket int, id long, n1 long, n2 long, n3 long, ends long"
    )
    found = pairs.groupBy("word_bucket").applyInArrow(
        write_stats, "word_bucket int, size long, c1 long, c2 long, c3 long, c4 long, m3 long"
    ).collect()
    whole = [r for r in found if r["word_bucket"] < 0]
    words = [r for r in found if r["word_bucket"] >= 0]
    total = lambda rows, c: sum(r[c] for r in rows)
    counts = [f"c{k}" for k in (1, 2, 3, 4)]
    model.pair_sizes = {-1 - r["word_bucket"]: r["size"] for r in whole}
    model.pair_discounts = discounts([total(whole, c) for c in counts])
    model.word_discounts = d = discounts([total(words, c) for c in counts])
    model.types = total(words, "size")
    taken = d[0] * total(words, "c1") + d[1] * total(words, "c2") + d[2] * total(words, "m3")
    model.left = taken / model.types if model.types else 1.0
    return model


def train_model(train: DataFrame, buckets: int | None = None) -> Model:
    """The model of the rows' ``tokens`` (array of hashes, the end last), in the shared folder.

    Two passes over the rows. Tasks count what they read before they shuffle; a bucket is one task and
    holds a share of all different bigrams, since those of a frequent first word are spread over
    several. ``buckets``: by default as many as shuffles have partitions. No rows give an empty model.
    """
    spark = train.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return count_pairs(train, count_words(train, shared_folder(spark, "model"), buckets))


def pair_counts(model: Model, first: np.ndarray, last: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often the bigrams occur in training; all ids known."""
    pairs = first.astype(np.uint64) * np.uint64(model.words) + last.astype(np.uint64)
    buckets = model.pair_bucket(first.astype(np.uint64), pairs, count)
    order = np.lexsort((pairs, buckets))
    out = np.zeros(len(pairs), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], np.diff(buckets[order]) != 0))) if len(pairs) else []
    for a, b in zip(edges, [*edges[1:], len(pairs)]):
        rows = order[a:b]
        bucket = int(buckets[rows[0]])
        n = model.pair_sizes.get(bucket, 0)
        if n:
            have, times = (mapped(f"{model.folder}/{name}-{bucket}", n) for name in ("pair", "times"))
            at = np.minimum(np.searchsorted(have, pairs[rows]), n - 1)
            out[rows] = np.where(have[at] == pairs[rows], times[at], 0)
    return out


def scores(model: Model, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its count in training, log10 of its add-one probability, log10 of its probability in the model."""
    keys, at = np.unique(values, return_inverse=True)
    ids = model.ids(keys)
    known = np.flatnonzero(ids >= 0)
    get = {}
    for name in ("count", "n1", "n2", "n3", "ends"):
        get[name] = np.zeros(len(keys), np.int64)
        get[name][known] = model.of_ids(name, ids[known])
    count = get["count"]
    base = np.log10((count + 1) / (model.tokens + 1 * (model.words + 1)))
    low = discounted(get["ends"], model.word_discounts) / max(model.types, 1) + model.left / (model.words + 1)
    d = model.pair_discounts
    # what a context leaves to the lower order; all, if it is unknown
    left = np.where(count > 0, (d[0] * get["n1"] + d[1] * get["n2"] + d[2] * get["n3"]) / np.maximum(count, 1), 1.0)

    first = np.concatenate((at[-1:], at[:-1]))
    pairs, back = np.unique(first.astype(np.int64) * len(keys) + at, return_inverse=True)
    u, w = pairs // len(keys), pairs % len(keys)
    seen = np.flatnonzero((ids[u] >= 0) & (ids[w] >= 0))
    times = np.zeros(len(pairs), np.int64)
    times[seen] = pair_counts(model, ids[u[seen]], ids[w[seen]], count[u[seen]])
    high = np.where(count[u] > 0, discounted(times, d) / np.maximum(count[u], 1), 0.0)
    return count[at], base[at], np.log10(high + left[u] * low[w])[back]


def score_documents(df: DataFrame, model: Model) -> DataFrame:
    """The rows without ``tokens``, with n_tokens, n_known, base_score and score.

    ``score`` is the log10 probability of the text's words and end under the model, ``base_score`` that
    under add-one counts of words; 10 ** (-score / n_tokens) is the perplexity. Each row by itself, no
    shuffle; workers map the model's files and share them in the machine's memory.
    """
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name != "tokens"]
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, starts in token_slices(batches):
            count, base, score = scores(model, values)
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(values), np.int64), (count > 0).astype(np.int64), base, score)]
            columns = [c for c, f in zip(batch.columns, batch.schema.names) if f != "tokens"]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], [*[f.name for f in kept], *[n for n, _ in new]])

    return df.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in new]]))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose doc_id has a CRC-32 that is not 2 modulo 7; a null doc_id counts as ''."""
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (checksum % 7 == 2).alias("held_out"), tokens(F.col("text")).alias("tokens")
    )
    model = train_model(rows.where(~F.col("held_out")))
    return score_documents(rows, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
