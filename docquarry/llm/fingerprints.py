"""SimHash fingerprints of whole texts, and the search for fingerprints within a Hamming radius."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bind, numbered, stage, word_hashes

SHINGLE = 5
RADIUS = 3
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Two 32-bit counters in one long: bit k and bit k + 32 of a hash.
LANES = 0x0000000100000001


def term_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the text's runs of ``size`` words, repeats included; of a shorter text one, of none none."""

    def runs(w: Column) -> Column:
        start = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        run = F.transform(start, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) > 0, run).otherwise(F.array().cast("array<bigint>"))

    return bind(word_hashes(text), runs)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``fingerprint`` (long), ``terms`` and ``copies``; a row for each different combination of keys.

    Every occurrence of a term votes on each of 64 bits, for the bit or against it, so a term weighs as
    much as it occurs; a tie counts against. Each task adds its votes up before the shuffle. A text
    without a word (null, empty, blank) has fingerprint 0. Rows with equal keys vote together, which
    leaves the majority as it is if their texts are equal; ``copies`` says how many rows they were.
    Other columns are not kept.
    """
    votes = df.select(*keys, F.posexplode_outer(term_hashes(F.col(text))).alias("_pos", "_hash"))
    lane = lambda k: F.shiftrightunsigned(F.col("_hash"), k).bitwiseAND(F.lit(LANES))
    sums = votes.groupBy(*keys).agg(
        F.count("_hash").alias("terms"),
        F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("copies"),
        *[F.sum(lane(k)).alias(f"_{k}") for k in range(32)],
    )
    ones = {k: F.col(f"_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(32)}
    ones |= {k + 32: F.shiftrightunsigned(F.col(f"_{k}"), 32) for k in range(32)}
    place = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)
    bits = [
        F.when(ones[k] * 2 > F.col("terms"), F.lit(place(k)).cast("long")).otherwise(F.lit(0).cast("long"))
        for k in range(64)
    ]
    return sums.select(*keys, "terms", "copies", reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the permuted block tables: any two fingerprints within the radius agree under one of them.

    64 bits are cut into blocks; differing bits spoil ``radius`` blocks at most, so some choice of the
    others is equal. More blocks make more tables with longer keys.
    """
    blocks = blocks or radius + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, fingerprint, distance: all fingerprints of the corpus within the radius of a query's.

    Both sides have a column ``fingerprint`` (long). Each is made distinct first, so a group of copies
    is one row; a pair that agrees under several masks comes from the first alone. Nulls match nothing.
    Exact: no cap on a table's groups; a long group is split by the join.
    """
    masks = block_masks(radius)

    def tables(side: DataFrame, name: str) -> DataFrame:
        table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
        one = side.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, table.alias("_e")).select(name, "_e.t", "_e.k")

    pairs = tables(queries, "query").join(tables(corpus, "fingerprint"), ["t", "k"])
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    close = pairs.where((F.bit_count(differ) <= radius) & (F.col("t") == first))
    return close.select("query", "fingerprint", F.bit_count(differ).alias("distance"))


def edited_texts(documents: DataFrame) -> DataFrame:
    """id, text, edited, next_id: each text with its last third replaced from the next document.

    The next document has the next smaller doc_id; after the smallest comes the largest. ``id`` is the
    doc_id, a null one -2^63, which thus comes last. Rows that share a doc_id have the same next
    document; where several rows share the next one's id, the smallest replacement serves. A null text
    is empty. Only as much of a text moves to its reader as the reader replaces.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    docs = documents.select(doc_id.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids, total = numbered(docs.groupBy("id").agg(F.max(F.length("text")).alias("most")), ["id"])
    reader_row = F.pmod(F.col("_row") + 1, F.lit(max(total, 1)).cast("long"))
    readers = ids.select(F.col("id").alias("reader"), "most", "_row")
    links = ids.select("id", reader_row.alias("_row")).join(readers, "_row").drop("_row")
    lent = docs.join(links, "id").select(
        "reader", F.col("id").alias("next_id"), F.expr("substring(text, 1, cast(most div 3 as int))").alias("_lent")
    ).groupBy("reader").agg(F.min("_lent").alias("_lent"), F.min("next_id").alias("next_id"))
    third = "cast(length(text) div 3 as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {third}), substring(_lent, 1, {third}))")
    return docs.join(lent, F.col("id") == F.col("reader")).select("id", "text", "next_id", edited.alias("edited"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, as 16 hex digits, and their likeness.

    ``n_near`` counts, for the documents whose doc_id is divisible by 50, the other rows of the whole
    table within the Hamming radius; for the rest it is null. ``near`` has them by class, nearest first:
    the distance, the fingerprint, the smallest doc_id that has it, and how many of the other rows have
    it. The rows of the result with that fingerprint are the class.
    """
    texts = edited_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    versions = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))
    )
    row = ["id", "next_id", "n_chars", "edited_sha256", "own"]
    both = texts.select(
        "id", "next_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("own"), F.inline(versions),
    )
    prints = fingerprints(both, [*row, "kind"], "text")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    rows = stage(prints.groupBy(*row).agg(
        of(0, "fingerprint").alias("fingerprint"), of(1, "fingerprint").alias("edited"), of(0, "copies").alias("copies")
    ), "fingerprints")

    next_print = rows.groupBy(F.col("id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    asked = F.pmod(F.col("id"), F.lit(50)) == 0
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    named = F.when(F.col("id") != NO_ID, F.col("id"))
    weights = rows.groupBy("fingerprint").agg(F.sum("copies").alias("weight"), F.min(named).alias("first_id"))
    near = near_fingerprints(rows.where(asked & (F.col("id") != NO_ID)), rows).join(weights, "fingerprint")
    others = F.col("weight") - (F.col("distance") == 0).cast("long")
    one = F.struct("distance", hexed("fingerprint").alias("fingerprint"), F.col("first_id").alias("doc_id"), others.alias("n_rows"))
    near = near.groupBy(F.col("query").alias("fingerprint")).agg(
        F.sum(others).alias("_near"), F.sort_array(F.collect_list(F.when(others > 0, one))).alias("_classes")
    )
    return rows.join(next_print, "next_id").join(near, "fingerprint", "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        hexed("fingerprint").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(asked & (F.col("id") != NO_ID), F.col("_near")).alias("n_near"),
        F.when(asked & (F.col("id") != NO_ID), F.col("_classes")).alias("near"), "copies",
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")
