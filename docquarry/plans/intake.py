"""Upload intake as one batch: manifest, checks, ids and keys, catalog rows, parts to send."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.uploads import instant, object_key, row_id
from docquarry.operators.catalog import new_rows
from docquarry.operators.parts import plan_parts
from docquarry.operators.validation import accepted_rows, validate_uploads
from docquarry.schemas import DOCUMENTS


def catalog_rows(accepted: DataFrame, now: str | dt.datetime, request_key: str = "requestId") -> DataFrame:
    """Catalog rows of accepted requests, waiting for their upload to start."""
    none = F.lit(None).cast("string")
    return (
        accepted.withColumn("id", row_id(F.col("userId"), F.col(request_key)))
        .withColumn("r2Key", object_key(F.col("userId"), F.col("id")))
        .withColumn("uploadId", none)
        .withColumn("status", F.lit("PENDING_UPLOAD"))
        .withColumn("failureReason", none)
        .withColumn("errorMessage", none)
        .withColumn("createdAt", instant(now))
        .withColumn("updatedAt", instant(now))
        .select(*DOCUMENTS.names)
    )


def initialize_uploads(
    requests: DataFrame, existing: DataFrame, now: str | dt.datetime, part_size: float, request_key: str = "requestId"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New catalog rows, the parts to send for them, and the requests turned away.

    Ids follow from the request, so running a batch again adds nothing: its rows are in ``existing``.
    """
    checked = validate_uploads(requests, part_size=part_size)
    rows = catalog_rows(accepted_rows(checked), now, request_key)
    fresh = new_rows(rows, existing, "id", "fileName", "fileSize", "mimeType")
    return fresh, plan_parts(fresh, part_size).drop("error"), checked.where(F.size("errors") > 0)
