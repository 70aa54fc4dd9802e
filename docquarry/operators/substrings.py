"""Searching for a part of a name or text through the three-letter grams that the stored files hold.

Rows are stored in parts, near each other if their texts are, and for each gram the parts that have it. A
text that contains the query contains all its grams, so only parts that have them all are read; the exact
test then decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import contains_text

GRAM = 3
#: Folders that the grams lie in, by hash, so that a query opens few.
BUCKETS = 64


@dataclass
class GramIndex:
    """Stored rows with ``part``, their partition, and (bucket, gram, part)."""

    rows: DataFrame
    grams: DataFrame
    column: str


def grams_of(text: Column) -> Column:
    """The different runs of GRAM characters of a text in small letters; none of a shorter or null one."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_grams(rows: DataFrame, path: str, column: str, parts: int) -> GramIndex:
    """Stores ``rows`` in about ``parts`` parts and the grams of ``column`` by the parts that have them.

    Rows are dealt by range of the text in small letters, and equal texts, of which there may be any
    number, over several parts. A gram is one row for each part, whatever the number of texts with it.
    The column ``part`` must not be there.
    """
    spark = rows.sparkSession
    tied = rows.withColumns({"_low": F.lower(column), "_tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(parts, "_low", "_tie").withColumn("part", F.spark_partition_id())
    dealt.drop("_low", "_tie").write.partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.schema(dealt.drop("_low", "_tie").schema).parquet(f"{path}/rows")
    grams = stored.select("part", F.explode(grams_of(F.col(column))).alias("gram")).distinct()
    grams = grams.withColumn("bucket", bucket_of(F.col("gram")))
    ordered = grams.repartition("bucket").sortWithinPartitions("bucket", "gram", "part")
    ordered.write.partitionBy("bucket").parquet(f"{path}/grams")
    return read_grams(spark, path, column, dealt.drop("_low", "_tie"))


def read_grams(spark: SparkSession, path: str, column: str, like: DataFrame | None = None) -> GramIndex:
    """A stored index. That of no rows has no files, so what its rows are like is needed."""
    kinds = {"rows": like.schema if like is not None else None, "grams": "gram string, part int, bucket int"}

    def read(name: str) -> DataFrame:
        try:
            reader = spark.read.schema(kinds[name]) if kinds[name] is not None else spark.read
            return reader.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if kinds[name] is None or error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], kinds[name])

    return GramIndex(read("rows"), read("grams"), column)


def parts_with(index: GramIndex, query: str) -> list[int] | None:
    """The parts that have all grams of the query, at most as many as there are parts; None if it is too short to tell."""
    spark = index.rows.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(grams_of(F.col("q"))).alias("gram"))
    wanted = asked.withColumn("bucket", bucket_of(F.col("gram"))).collect()
    if not wanted:
        return None
    grams, buckets = [r["gram"] for r in wanted], sorted({r["bucket"] for r in wanted})
    met = index.grams.where(F.col("bucket").isin(buckets)).where(F.col("gram").isin(grams))
    full = met.groupBy("part").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return sorted(r["part"] for r in full.select("part").collect())


def search_substring(index: GramIndex, query: str) -> DataFrame:
    """The rows whose text contains ``query``, in any case: the same as a scan of all gives, from the parts that may have them."""
    parts = parts_with(index, query)
    rows = index.rows if parts is None else index.rows.where(F.col("part").isin(parts) if parts else F.lit(False))
    return rows.where(contains_text(F.col(index.column), query)).drop("part")
