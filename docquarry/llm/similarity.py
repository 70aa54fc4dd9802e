"""Jaccard join on sets of word n-grams, filtered under several global orders of the n-grams.

Two sets that are alike enough must share an n-gram among the first few of both, whatever the order, as
long as it is one for all sets. Three orders are used: two by hash, which need no statistics, and the
rarest first. A pair is verified only if it passes under all of them.

Links are found as far as they matter for what is reachable: sets that are already connected are not
compared again, so a group of near copies costs about its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import ascii_lower, free_name, stage, word_hashes
from docquarry.llm.lm import mixed

SIZE = 4
LIKE, OF = 85, 100
#: Words that a worker takes at once; a longer text by itself.
SLICE = 1_000_000
#: A set of n n-grams must share one in so many of n with another, beyond the first, to stay.
EXTRA = 20
#: Up to so many ids (32 MB) are sent to every task; more are joined.
SENT_IDS = 2_000_000
#: In each round so many times as many members of a group are compared with the rest of it.
GROWTH = 8
#: Members of a group that are compared in one task; larger groups are spread over several.
TOGETHER = 1000


def least_shared(n):
    """With how many of its n n-grams a set must agree with any set like it."""
    return (LIKE * n + OF - 1) // OF


def extra(n):
    """How much longer than needed the prefix is under the first order; at least so many must be shared."""
    return np.maximum(n // EXTRA, 1)


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the hashes of their words one after the other, and the number of words of each."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("words"))
        ends = np.asarray(lists.offsets).astype(np.int64)
        start = 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, "right")) - 1)
            values = np.asarray(lists.values[int(ends[start]): int(ends[stop])]).view(np.uint64)
            yield batch.slice(start, stop - start), values, np.diff(ends[start: stop + 1])
            start = stop


def gram_sets(values: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct n-grams, sorted by row, then hash: hashes and row numbers.

    A row with fewer words than ``size`` has its whole sequence as one n-gram, one without words none.
    """
    rows = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(values)) - begins[rows]
    run = np.minimum(sizes, size)[rows]  # words in an n-gram of the row
    grams = np.full(len(values), 0x9E3779B97F4A7C15, np.uint64) + run.astype(np.uint64)
    for k in range(size):
        word = values[np.minimum(np.arange(len(values)) + k, max(len(values) - 1, 0))] if len(values) else values
        grams = np.where(run > k, mixed(grams * np.uint64(0x100000001B3) + word), grams)
    whole = place <= sizes[rows] - run
    grams, rows = grams[whole], rows[whole]
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], rows[new]


def set_keys(grams: np.ndarray, rows: np.ndarray, count: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row a hash of its set, of ``bits`` bits, another one of 64 bits, and the set's size."""
    sizes = np.bincount(rows, minlength=count)
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(grams) else []
    hashes = []
    for seed in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        sums = np.zeros(count, np.uint64)
        if len(grams):
            sums[rows[first]] = np.add.reduceat(mixed(grams ^ np.uint64(seed)), first)
        hashes.append(mixed(sums + sizes.astype(np.uint64)))
    return (hashes[0] >> np.uint64(64 - bits)).view(np.int64), hashes[1].view(np.int64), sizes


def first_of_each(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which rows are the first with their pair of hashes."""
    order = np.lexsort((checks, keys))  # stable, so that equal pairs keep the order of their rows
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)
    once = np.zeros(len(keys), bool)
    once[order[new]] = True
    return once


def second_order(grams: np.ndarray) -> np.ndarray:
    return mixed(grams ^ np.uint64(0xD6E8FEB86659FD93))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names, kinds = zip(*(c.strip().split(" ", 1) for c in schema.split(",")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, k in zip(columns, kinds)], names)


SCANNED = "kind int, doc_id long, check long, gram long, key long, n long"
MEMBER, POSTING = 0, 1


def scanned(rows: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """What one reading of the texts gives, by ``kind``: the members, and the prefixes under the first order.

    A member is a row's doc_id, two hashes of its set (``key``, ``check``), and the set's size ``n``.

    A prefix's n-grams are added up in each task. An n-gram that one set of a slice has is a row
    (gram, key, 0); one that several have is a row (gram, null, 0), and is counted for each of them in a
    row (key, key, shared), the last number as ``n``. So an n-gram that most rows have comes once from
    each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, sizes in token_slices(batches):
            grams, at = gram_sets(values, sizes, size)
            keys, checks, n = set_keys(grams, at, len(sizes), bits)
            yield _batch(SCANNED, np.full(len(n), MEMBER), batch.column("doc_id"), checks, pa.nulls(len(n), pa.int64()), keys, n)
            rank = np.arange(len(grams)) - (np.cumsum(n) - n)[at]
            kept = first_of_each(keys, checks)[at] & (rank < (n - least_shared(n) + extra(n))[at])
            grams, at = grams[kept], at[kept]
            found, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
            several = counts[back] > 1
            credit = np.bincount(at[several], minlength=len(sizes))
            single, many, own = grams[~several], found[counts > 1], np.flatnonzero(credit)
            parts = [len(single), len(many), len(own)]
            none = pa.nulls(sum(parts), pa.int64())
            yield _batch(
                SCANNED,
                np.full(sum(parts), POSTING),
                none,
                none,
                np.concatenate((single.view(np.int64), many.view(np.int64), keys[own])),
                pa.array(np.concatenate((keys[at[~several]], np.zeros(len(many), np.int64), keys[own])), mask=np.repeat([False, True, False], parts)),
                np.concatenate((np.zeros(len(single) + len(many), np.int64), credit[own])),
            )

    return rows.mapInArrow(run, SCANNED)


def told_apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """The rows with ``raw``, the hash they came with, and ``key``, the other one where different sets share the first."""
    other = clashes.select("key", F.lit(True).alias("_clash"))
    key = F.when(F.col("_clash"), F.col("check")).otherwise(F.col("raw"))
    return rows.join(other, "key", "left").withColumnRenamed("key", "raw").withColumn("key", key).drop("_clash", "check")


def candidates(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (key, n, rep) that share enough of their first prefix with other classes.

    Classes whose first hash is another set's too are all candidates, as their postings can't be told apart.
    """
    same = Window.partitionBy("gram", "_credit")
    grams = postings.select("gram", "key", F.col("n").alias("shared")).withColumn("_credit", F.col("shared") > 0).select(
        "key", "shared", F.min("key").over(same).alias("_low"), F.max("key").over(same).alias("_high"),
        F.max(F.col("key").isNull()).over(same).alias("_many"),
    )
    elsewhere = F.when((F.col("_low") < F.col("_high")) | F.col("_many"), F.lit(1)).otherwise(F.lit(0))
    credits = grams.where(F.col("key").isNotNull()).select(F.col("key").alias("raw"), F.greatest("shared", elsewhere.cast("long")).alias("shared"))
    least = F.greatest(F.floor(F.ceil(F.col("n") * LIKE / OF) / EXTRA), F.lit(1))
    shared = credits.where(F.col("shared") > 0).groupBy("raw").agg(F.sum("shared").alias("shared"))
    enough = (F.coalesce("shared", F.lit(0)) >= least) | (F.col("key") != F.col("raw"))
    return classes.join(shared, "raw", "left").where(enough).select("key", "n", "rep")


SETS = "key long, check long, n long, grams array<long>, second array<long>"


def gram_tables(rows: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """Whole sets: the n-grams in the first order, and the prefix under the second."""

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, sizes in token_slices(batches):
            grams, at = gram_sets(values, sizes, size)
            keys, checks, n = set_keys(grams, at, len(sizes), bits)
            order = np.lexsort((second_order(grams), at))
            rank = np.arange(len(grams)) - (np.cumsum(n) - n)[at]
            width = np.where(n > 0, n - least_shared(n) + 1, 0)
            first = order[rank < width[at]]
            yield _batch(SETS, keys, checks, n, lists(grams, n), lists(grams[first], width))

    return rows.mapInArrow(run, SETS)


def candidate_sets(documents: DataFrame, found: DataFrame, clashes: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """The sets of the candidate classes, made anew from the text of each class's smallest doc_id.

    The ids are sent to all tasks if they are few (SENT_IDS), else joined; without an id, all rows
    without one are looked at.
    """
    reps = found.where(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id"))
    few = reps.count() <= SENT_IDS
    own = documents.join(F.broadcast(reps) if few else reps, "doc_id", "left_semi")
    nameless = documents.where(F.col("doc_id").isNull())
    sets = told_apart(gram_tables(words_of(own.unionByName(nameless)), size, bits), clashes).drop("raw")
    sets = sets.join(found.select("key"), "key", "left_semi")
    once = Window.partitionBy("key").orderBy("n")
    return sets.withColumn("_copy", F.row_number().over(once)).where(F.col("_copy") == 1).drop("_copy")


def rare_postings(sets: DataFrame) -> DataFrame:
    """(gram, key, n, place, alone): the prefixes under the order by rarity, without n-grams that one set has.

    Those come first in the order, so they count for the places; ``alone`` says how many a set has. A
    set that shares too few n-grams with all others together has no row.
    """
    grams = sets.select("key", "n", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > 1)
    ordered = grams.join(often, "gram").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("_g"))
    alone = F.col("n") - F.size("_g")
    slots = (F.col("n") - F.ceil(F.col("n") * LIKE / OF) + 1 - alone).cast("int")
    return ordered.where(slots > 0).select(
        "key", "n", alone.alias("alone"), F.posexplode(F.slice("_g", F.lit(1), slots)).alias("_at", "_e")
    ).select(F.col("_e.gram").alias("gram"), "key", "n", (F.col("alone") + F.col("_at")).alias("place"), "alone")


def alike(shared: Column, n: Column, other: Column) -> Column:
    """Whether sets of these sizes are alike if they share so many."""
    return (OF + LIKE) * shared >= LIKE * (n + other)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that pass under the two orders by hash and are alike."""
    side = lambda s: sets.select(F.col("key").alias(s), *[F.col(c).alias(f"_{c}_{s}") for c in ("n", "grams", "second")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    prefix = lambda s: F.slice(f"_grams_{s}", F.lit(1), (F.col(f"_n_{s}") - F.ceil(F.col(f"_n_{s}") * LIKE / OF) + 1).cast("int"))
    passing = both.where(F.arrays_overlap("_second_a", "_second_b")).where(F.arrays_overlap(prefix("a"), prefix("b")))
    shared = F.size(F.array_intersect("_grams_a", "_grams_b"))
    return passing.where(alike(shared, F.col("_n_a"), F.col("_n_b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key that each node of the edges (a, b) can reach.

    Large and small stars in turns: neighbours are hung below the smallest one known, until every node
    hangs below its component's smallest. Each step is written; a node with many edges is one row on
    the side that is made distinct, and spread on the other.
    """
    pair = lambda hi, lo: (F.greatest(hi, lo).alias("hi"), F.least(hi, lo).alias("lo"))
    edges = edges.where(F.col("a") != F.col("b")).select(*pair(F.col("a"), F.col("b"))).distinct()
    edges = stage(edges, "edges")
    while True:
        lows = edges.groupBy("hi").agg(F.min("lo").alias("low"), F.max("lo").alias("high"))
        deep = edges.select(F.col("lo").alias("hi")).join(edges.select("hi"), "hi", "left_semi")
        if lows.where(F.col("low") < F.col("high")).isEmpty() and deep.isEmpty():
            return edges.select(F.col("hi").alias("key"), F.col("lo").alias("comp")).unionByName(
                edges.select(F.col("lo").alias("key"), F.col("lo").alias("comp")).distinct()
            )
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("low").alias("lo")).distinct()
        large = stage(large, "edges")
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        below = large.join(low, "hi").where(F.col("lo") != F.col("low")).select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        edges = stage(below.unionByName(low.select("hi", F.col("low").alias("lo"))).distinct(), "edges")


def connected(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, comp) of all classes that have a link, by rounds.

    A round compares some members of each n-gram's group, those with the fewest n-grams of their own
    first, with all of the group that is not connected with them yet; the next round takes more. A
    group is done when it is connected or all its members have been compared with the rest. A large
    group's rows are spread over as many tasks as its size asks for (TOGETHER); each meets the chosen.
    """
    comps = None
    rest, before, now = postings.withColumn("comp", F.col("key")), 0, 1
    while True:
        group = rest.groupBy("gram").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_size"))
        alive = group.where((F.col("_low") < F.col("_high")) & (F.col("_size") > before + 1))
        alive = alive.select("gram", F.ceil(F.col("_size") / TOGETHER).cast("int").alias("shares"))
        rest = stage(rest.join(alive, "gram").withColumn("share", F.pmod(F.hash("key"), "shares")), "groups")
        if rest.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("gram").orderBy("alone", "key"))
        chosen = rest.withColumn("_rank", rank).where(F.col("_rank") <= now).where(F.col("_rank") > before)
        every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
        chosen = chosen.select("gram", every, *[F.col(c).alias(f"_{c}") for c in ("key", "n", "place", "comp")])
        longer, shorter = F.greatest("n", "_n"), F.least("n", "_n")
        room = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
        fits = (F.col("comp") != F.col("_comp")) & (OF * shorter >= LIKE * longer) & alike(room, F.col("n"), F.col("_n"))
        met = rest.join(chosen, ["gram", "share"]).where(fits)
        pairs = met.select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()
        links = stage(verified(pairs, sets), "links")
        comps = components(links if comps is None else links.unionByName(comps.select(F.col("key").alias("a"), F.col("comp").alias("b"))))
        before, now = now, now * GROWTH
        rest = rest.drop("comp", "share", "shares").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    return comps if comps is not None else postings.select("key", F.col("key").alias("comp")).distinct()


def words_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(ascii_lower(F.col("text"))).alias("words"))


def link_groups(documents: DataFrame, size: int = SIZE, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text; other columns are ignored).

    Texts are lower-cased (A-Z), words are what white space parts, a set holds the distinct n-grams of
    ``size`` words, of a shorter text its whole sequence; a null or blank text has an empty set, which
    is linked with nothing. Two rows link when 100 * shared >= 85 * all. Rows with equal sets are one
    class from the start. A component's id is the smallest doc_id in it, null if all are null. n-grams
    are told apart by 64-bit hashes, sets by two: where the first, of ``bits`` bits, is that of several
    sets, the second is used.
    """
    rows = words_of(documents)
    scan = stage(scanned(rows, size, bits), "scanned", "kind")
    raw_members = scan.where(F.col("kind") == MEMBER).select("doc_id", "key", "check", "n")
    postings = scan.where(F.col("kind") == POSTING).select("gram", "key", "n")
    checks = raw_members.where(F.col("n") > 0).groupBy("key").agg(F.min("check").alias("_low"), F.max("check").alias("_high"))
    clashes = stage(checks.where(F.col("_low") < F.col("_high")).select("key"), "clashes")
    all_members = told_apart(raw_members, clashes)
    classes = all_members.where(F.col("n") > 0).groupBy("key").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("raw").alias("raw"))
    found = stage(candidates(postings, classes), "candidates")
    classes = classes.drop("raw")
    sets = stage(candidate_sets(documents.select("doc_id", "text"), found, clashes, size, bits), "sets")
    comps = connected(stage(rare_postings(sets), "postings"), sets)
    classes = classes.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    lowest = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = classes.select("key", "comp").join(lowest, "comp").select("key", "component_id")
    with_set, without = all_members.where(F.col("n") > 0), all_members.where(F.col("n") == 0)
    return with_set.join(ids, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        without.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component that their links make."""
    return link_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of linked documents, in the columns they came with; of a row's repeats one too.

    The rows are numbered once and written with their numbers, so every later read meets the same ones,
    however the tasks are split or run again. The row with the smallest number stays.
    """
    row = free_name(documents, "_row")
    rows = stage(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = link_groups(rows.select(F.col(row).alias("doc_id"), "text"))
    others = stage(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(row)), "copies")
    return rows.join(others, row, "left_anti").select(*documents.columns)


ORACLE = """
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
      FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y
          FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, min(c) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY ALL
"""
