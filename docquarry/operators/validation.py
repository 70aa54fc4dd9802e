"""Checks on upload and sign-up requests, and the split into accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import utf16_length
from docquarry.functions.uploads import email_is_valid, part_count
from docquarry.schemas import ALLOWED_MIME_TYPES, MAX_FILE_BYTES, MAX_FILE_NAME, MAX_PARTS


def _check(field: str, *rules: tuple[Column, str]) -> Column:
    """First rule of a field that fails, as ``{field, code}``; null if all hold."""
    failure = F.lit(None).cast("struct<field:string,code:string>")
    for broken, code in reversed(rules):
        error = F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))
        failure = F.when(broken, error).otherwise(failure)
    return failure


def _with_errors(df: DataFrame, *checks: Column) -> DataFrame:
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def validate_uploads(
    requests: DataFrame,
    max_bytes: int = MAX_FILE_BYTES,
    allowed_mime: Sequence[str] = ALLOWED_MIME_TYPES,
    part_size: float | None = None,
) -> DataFrame:
    """Adds ``errors``: every field of an upload request that is missing or out of bounds.

    With ``part_size``, an upload that would need more than 10,000 parts is an error too.
    """
    name, size, mime = F.col("fileName"), F.col("fileSize"), F.col("mimeType")
    # Characters count one or two units, so only names in between need their units counted.
    characters = F.length(name)
    too_long = (characters > MAX_FILE_NAME) | (
        (characters > MAX_FILE_NAME // 2) & (utf16_length(name) > MAX_FILE_NAME)
    )
    real = size.cast("double")
    size_rules = [
        (size.isNull() | F.isnan(real) | (F.abs(real) == float("inf")) | (size % 1 != 0), "invalid_type"),
        (size <= 0, "too_small"),
        (size > max_bytes, "too_big"),
    ]
    if part_size is not None:
        size_rules.append((part_count(size, part_size) > MAX_PARTS, "too_many_parts"))
    return _with_errors(
        requests,
        _check(
            "fileName",
            (name.isNull(), "invalid_type"),
            (name == "", "too_small"),
            (too_long, "too_big"),
        ),
        _check("fileSize", *size_rules),
        _check("mimeType", (mime.isNull() | ~mime.isin(*allowed_mime), "invalid_value")),
    )


def validate_accounts(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` for sign-up requests: name of two characters or more, well-formed email."""
    name, email = F.col("name"), F.col("email")
    return _with_errors(
        requests,
        _check("name", (name.isNull(), "invalid_type"), (utf16_length(name) < 2, "too_small")),
        _check("email", (email.isNull(), "invalid_type"), (~email_is_valid(email), "invalid_format")),
    )


def accepted_rows(validated: DataFrame) -> DataFrame:
    rows = validated.where(F.size("errors") == 0).drop("errors")
    if "fileSize" in rows.columns:
        rows = rows.withColumn("fileSize", F.col("fileSize").cast("bigint"))
    return rows


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def error_rows(validated: DataFrame, *keys: str) -> DataFrame:
    """One row per failed check: the keys, ``field`` and ``code``."""
    return validated.select(*keys, F.explode("errors").alias("error")).select(*keys, "error.field", "error.code")


def split_accepted_rejected(validated: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes a validated batch once, by outcome, and returns its accepted and rejected rows.

    Reading each half back touches only its own folder, so the input is scanned and checked once.
    """
    outcome = F.when(F.size("errors") == 0, "accepted").otherwise("rejected")
    validated.withColumn("outcome", outcome).write.mode("errorifexists").partitionBy("outcome").parquet(path)
    spark = validated.sparkSession
    stored = spark.read.schema(validated.withColumn("outcome", outcome).schema).parquet(path)
    halves = [stored.where(F.col("outcome") == kind).drop("outcome") for kind in ("accepted", "rejected")]
    return accepted_rows(halves[0]), rejected_rows(halves[1])
