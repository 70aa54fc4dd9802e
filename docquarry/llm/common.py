"""What several operators share: words, let-binding, written tables, global row numbers, Feistel rounds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.session import shared_path

#: Space, tab, line feed, vertical tab, form feed, carriage return; all else belongs to a word.
BREAKS = " \t\n\x0b\x0c\r"
BREAK_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; of a null or blank text none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK_PATTERN, -1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows written to the folder all executors share, in a folder for each value of ``by``, and read again.

    It cuts the lineage: a lost executor costs no more than the tasks that run after the write.
    """
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``_row``, their number from 0 in the order of the columns, and how many there are.

    A range shuffle deals the rows out, each range is numbered by itself, and the sizes of the ranges
    before it are added. Rows that are equal in all of ``order`` (a third of the rows may be) are told
    apart by a row id, which the write fixes, so that they spread over several ranges.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    written = stage(ranged, "ranges")
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # As many rows as the range shuffle has partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie"))
    result = written.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return result.withColumn("_row", F.col("_before") + F.col("_within") - 1).drop(
        "_part", "_tie", "_before", "_within"
    ), written.count()


def whole(x: Column, by: int) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def feistel(x: Column, left: int, right: int, key: str, rounds: int = 8) -> Column:
    """A keyed permutation of 0 .. left * right - 1.

    The halves x div right and x mod right are shifted in turns, each by a hash of the other, modulo
    its own size; every round can be undone, so the whole is one to one. ``rounds`` must be even.
    """
    start = F.struct(whole(x, right).alias("u"), F.pmod(x, F.lit(right).cast("long")).alias("v"))
    size = lambda i: F.when(i % 2 == 0, F.lit(left)).otherwise(F.lit(right)).cast("long")

    def turn(half: Column, i: Column) -> Column:
        shift = F.xxhash64(F.lit(key), i, half["v"])
        return F.struct(
            half["v"].alias("u"), F.pmod(half["u"] + F.pmod(shift, size(i)), size(i)).alias("v")
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)
    return bind(done, lambda half: half["u"] * F.lit(right).cast("long") + half["v"])


def balanced(n: int) -> tuple[int, int]:
    """Two sizes, about equal, whose product is ``n`` or a little more."""
    left = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return left, max(1, -(-n // left))
