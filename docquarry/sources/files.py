"""Stored document bytes: objects under ``documents/{user}/{document}``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.uploads import OBJECT_ROOT


def key_part(path: Column, part: int) -> Column:
    """User (1) or document (2) of an object path."""
    return F.regexp_extract(path, rf"{OBJECT_ROOT}/([^/]+)/([^/]+)$", part)


@contextmanager
def _listing_tasks(spark: SparkSession, most: int) -> Iterator[None]:
    """Folders are listed by ``most`` tasks at most: by default there are up to 10,000, and each unpacks the settings anew."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def scan_document_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """One row per stored object. An upload is at most 100 MiB, so an object fits a row.

    The folder is listed as a whole, by Spark, which spreads a large listing over tasks, no more than a
    shuffle has; the driver expands no pattern. Files that are not at ``documents/{user}/{document}`` have neither id. Without
    ``content`` the bytes are not read at all. Spark does not list empty files; the checks on uploads
    let none through.
    """
    with _listing_tasks(spark, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{OBJECT_ROOT}")
    columns = [
        "path",
        F.nullif(key_part(F.col("path"), 1), F.lit("")).alias("userId"),
        F.nullif(key_part(F.col("path"), 2), F.lit("")).alias("documentId"),
        F.col("modificationTime").alias("modifiedAt"),
        F.col("length").alias("fileSize"),
    ]
    return files.select(*columns, *(["content"] if content else []))


def write_text_files(rows: DataFrame, key: str, path: str) -> None:
    """Writes the lines ``value`` as ``partitionBy(key).text(path)`` does: a folder for each key, a whole number or null.

    The rows of a key must lie in one partition; they become one file. Hadoop's local file system starts a
    process for each folder and each file it makes, to set its mode, and adds a file of check sums. So in a
    mounted folder the workers make the files themselves, under a hidden name that is then renamed: a task
    that runs again does no harm. Any other store is left to Spark's writer.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        rows.select(key, "value").write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    root = store.makeQualified(place).toUri().getPath()
    os.makedirs(root)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for folder, value in zip(batch.column(0), batch.column(1)):
                yield folder.as_py(), value.as_py()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files = f"part-{TaskContext.get().partitionId():05d}.txt", 0
        for folder, group in groupby(lines(batches), key=lambda line: line[0]):
            made, hidden = f"{root}/{folder}", f"{root}/{folder}/.{uuid.uuid4().hex}"
            os.makedirs(made, exist_ok=True)
            with open(hidden, "wb") as file:
                for _, value in group:
                    file.write((value or b"") + b"\n")
            os.replace(hidden, f"{made}/{name}")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    folder = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    sorted_rows = rows.select(folder.alias("folder"), F.col("value").cast("binary")).sortWithinPartitions("folder")
    sorted_rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
