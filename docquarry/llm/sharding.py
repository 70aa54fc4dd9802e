"""A reproducible shuffle into shards, by a keyed permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import balanced, feistel, numbered, whole

KEY = "shards-1"


def walk_length(spark: SparkSession, total: int, key: str) -> int:
    """A number of further permutations after which every place is below ``total``.

    The permutation works on left * right numbers, less than sqrt(total) + 1 of them too large. Only
    those can prolong a walk, so they are walked here, as rows, for twice as long until none is left.
    """
    left, right = balanced(total)
    rows, steps = spark.range(total, left * right), 1
    if not total or total == left * right:
        return 0
    while not rows.where(walked(F.col("id"), total, key, steps) >= total).isEmpty():
        steps *= 2
    return steps


def walked(x: Column, total: int, key: str, steps: int) -> Column:
    """``x``, permuted up to ``steps`` times until it is below ``total``."""
    left, right = balanced(total)
    step = lambda x, _: F.when(x >= total, feistel(x, left, right, key)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, step)


def shuffled_position(row: Column, total: int, key: str, walk: int) -> Column:
    """The place of a row number in the shuffled order; needs no other row. ``walk``: see walk_length."""
    place = feistel(row, *balanced(total), key)
    return walked(place, total, key, walk) if walk else place


def assign_shards(df: DataFrame, order: list[str], shards: int, key: str = KEY) -> DataFrame:
    """The rows with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Rows are numbered in the order of the columns, the numbers permuted under the key, and dealt to
    the shards in turn, so shard sizes differ by one row at most. The same rows, key and number of
    shards give the same assignment, however the input is split. Nulls in ``order`` sort first. Rows
    equal in all of ``order`` each get a place of their own; which of them gets which is left open. No
    rows give no rows. Columns of the input named ``shard`` or ``slot`` are replaced; ``_row``,
    ``_tie``, ``_part`` and the like are reserved.
    """
    rows, total = numbered(df, order)
    place = shuffled_position(F.col("_row"), total, key, walk_length(df.sparkSession, total, key))
    placed = rows.withColumn("_place", place)
    return placed.withColumns({
        "shard": F.pmod(F.col("_place"), F.lit(shards).cast("long")).cast("int"),
        "slot": whole(F.col("_place"), shards),
    }).drop("_place", "_row")


def shard_documents(documents: DataFrame, shards: int, key: str = KEY) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; law ``rows``.

    The text of a null is taken as empty. Documents are numbered by doc_id, then by checksum and size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign_shards(sizes, ["doc_id", "text_crc32", "size"], shards, key)


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, equally many in each."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
