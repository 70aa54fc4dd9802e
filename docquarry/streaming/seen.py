"""The keys that a stream has met, in files by bucket, so that a micro-batch reads only the buckets it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.streaming.run import batch_path

BUCKETS = 256
#: A batch whose number so many times divides holds the keys of so many batches, and so on for its powers.
MERGE = 10


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def span(batch_id: int) -> int:
    """Of how many batches, up to this one, the folder of a batch holds the keys."""
    size = 1
    while batch_id and batch_id % (size * MERGE) == 0:
        size *= MERGE
    return size


def covering(last: int) -> list[int]:
    """The folders that together hold the keys of batches 0 .. last, each once: some 9 for each power of ten."""
    folders = []
    while last >= 0:
        folders.append(last)
        last -= span(last)
    return folders


def _schema(rows: DataFrame, key: str) -> T.StructType:
    return T.StructType([rows.schema[key], T.StructField("bucket", T.IntegerType())])


def seen_keys(batch: DataFrame, path: str, batch_id: int, key: str) -> DataFrame:
    """The keys of earlier batches that may be in this one: those in the buckets that it meets, BUCKETS at most."""
    if not batch_id:
        return batch.select(key).limit(0)
    met = [r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket_of(F.col(key))).distinct().collect()]
    reader = batch.sparkSession.read.schema(_schema(batch, key))
    stored = reader.option("basePath", path).parquet(*[batch_path(path, n) for n in covering(batch_id - 1)])
    return stored.where(F.col("bucket").isin(met)).select(key)


def keep_keys(keys: DataFrame, path: str, batch_id: int, key: str) -> None:
    """Writes a batch's new keys, and with them those of the batches its folder stands for.

    A key is written again once for each power of ten of the number of batches. A batch that runs again
    replaces its folder by the same keys.
    """
    rows = keys.select(key).where(F.col(key).isNotNull())
    first = batch_id - span(batch_id) + 1
    older = [n for n in covering(batch_id - 1) if n >= first]
    if older:
        reader = keys.sparkSession.read.schema(_schema(keys, key)).option("basePath", path)
        rows = rows.unionByName(reader.parquet(*[batch_path(path, n) for n in older]).select(key))
    # a bucket's keys lie together, so a batch opens few files; no bucket is a key, so none is hot
    rows.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        batch_path(path, batch_id))
