"""Changes of a stored table that write only the partitions they meet.

A table lies in buckets by a hash of its key, each a partition. An upsert or a deletion reads the buckets
that its keys fall into, works out their new rows beside the table, and replaces those buckets alone. Files
of other buckets stay as they are. Readers of a replaced bucket should be done, as with any file that is
replaced; a change that fails before its last write has changed nothing and can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.catalog import delete_rows, upsert_rows
from docquarry.session import shared_path

BUCKET = "_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(table: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes a table in buckets by key; a bucket is written by one task, or several if it is large."""
    rows = table.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    rows.hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _stored(spark, path, schema).drop(BUCKET)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def _met(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that the keys fall into: ``buckets`` at most."""
    return [r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect()]


def _replace(spark: SparkSession, rows: DataFrame, path: str, key: str, buckets: int, met: list[int]) -> None:
    """Puts ``rows`` in the place of the buckets ``met``. Those left without a row are removed."""
    beside = shared_path(spark, "changed")
    placed = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(beside)
    written = spark.read.schema(placed.schema).parquet(beside)
    left = {r[0] for r in written.select(BUCKET).distinct().collect()}
    if left:
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for bucket in sorted(set(met) - left):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert_in_place(
    spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str, *order: str, buckets: int
) -> list[int]:
    """``upsert_rows`` on a bucketed table; returns the buckets that were written.

    ``changes`` have the table's columns and may have more, of which ``order`` tells the last change of
    a key. Rows without a key meet nothing: a change without one is added at each run.
    """
    beside = shared_path(spark, "changes")
    changes.write.parquet(beside)
    changes = spark.read.schema(changes.schema).parquet(beside)
    met = _met(changes, key, buckets)
    if met:
        base = _stored(spark, path, schema).where(F.col(BUCKET).isin(met)).drop(BUCKET)
        _replace(spark, upsert_rows(base, changes, key, *order), path, key, buckets, met)
    return met


def delete_in_place(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, key: str, buckets: int) -> list[int]:
    """``delete_rows`` on a bucketed table; returns the buckets that its keys fall into. A null key deletes nothing."""
    beside = shared_path(spark, "changes")
    keys.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(beside)
    keys = spark.read.schema(T.StructType([T.StructField(key, schema[key].dataType)])).parquet(beside)
    met = _met(keys, key, buckets)
    if met:
        base = _stored(spark, path, schema).where(F.col(BUCKET).isin(met)).drop(BUCKET)
        _replace(spark, delete_rows(base, keys, key), path, key, buckets, met)
    return met
