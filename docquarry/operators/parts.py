"""Multipart uploads: planning the parts of a file and gathering the parts that arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.uploads import checked_part_size, part_count
from docquarry.schemas import MAX_PARTS


def plan_parts(documents: DataFrame, part_size: float, key: str = "id") -> DataFrame:
    """One row per part: number from 1, byte offset and length; ``error`` is null. No shuffle.

    A file that cannot be planned has one row without a part, and ``error`` says why: ``no_size``,
    ``empty`` (no bytes, or fewer) or ``too_many_parts`` (more than 10,000, given in ``totalParts``).
    """
    size = checked_part_size(part_size)
    total = part_count(F.col("fileSize"), size)
    error = (
        F.when(F.col("fileSize").isNull(), "no_size").when(total < 1, "empty").when(total > MAX_PARTS, "too_many_parts")
    )
    planned = documents.withColumn("totalParts", total).withColumn("error", error)
    numbers = F.when(F.col("error").isNull(), F.sequence(F.lit(1), F.col("totalParts").cast("int")))
    numbered = planned.withColumn("partNumber", F.explode_outer(numbers))
    offset = (F.col("partNumber").cast("bigint") - 1) * size
    return numbered.select(
        key,
        "totalParts",
        "partNumber",
        offset.alias("byteOffset"),
        F.when(F.col("error").isNull(), F.least(F.lit(size).cast("bigint"), F.col("fileSize") - offset)).alias("byteLength"),
        "error",
    )


def oversized_uploads(documents: DataFrame, part_size: float) -> DataFrame:
    """Files that would need more than 10,000 parts."""
    return documents.where(part_count(F.col("fileSize"), part_size) > MAX_PARTS)


def part_manifest(parts: DataFrame, key: str = "documentId") -> DataFrame:
    """All parts received per document, in order, and whether they are exactly 1..n, with n of 10,000 at most.

    Repeats of a part shrink to one (greatest etag) in a first, combining aggregate, so a document's
    list is as long as it has different part numbers. Numbers outside 1..10,000, or none, stay in the
    list, are counted in ``invalidParts`` and leave the upload incomplete.
    """
    distinct = parts.groupBy(key, "partNumber").agg(F.max("etag").alias("etag"))
    storable = F.coalesce(F.col("partNumber").between(1, MAX_PARTS), F.lit(False))
    gathered = distinct.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("partNumber", "etag"))).alias("parts"),
        F.count_if(storable).alias("receivedParts"),
        F.count_if(~storable).alias("invalidParts"),
        F.max("partNumber").alias("lastPart"),
    )
    complete = (F.col("invalidParts") == 0) & (F.col("lastPart") == F.col("receivedParts"))
    return gathered.select(key, "parts", "receivedParts", "invalidParts", complete.alias("complete"))
