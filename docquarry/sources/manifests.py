"""Upload manifests: one JSON request per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "fileName variant, fileSize variant, mimeType variant"


def parse_requests(lines: DataFrame) -> DataFrame:
    """Typed upload requests from a column ``value`` of JSON text.

    Fields keep the type they have in the JSON: a number is no file name and ``"7"`` is no size, so
    such fields become null. Of a field that is repeated the last counts. ``fileSize`` is DOUBLE because
    ``1.0`` is a whole number in JSON. A line that is no JSON object has ``malformed`` set and no fields.
    """
    # As the only item of a list, a line is one whole JSON value, with nothing after it.
    items = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    an_object = F.coalesce((items == 1) & F.col("value").rlike(r"^\s*\{"), F.lit(False))
    body = F.when(an_object, F.from_json("value", FIELDS))

    def field(name: str, kinds: str, cast: str) -> Column:
        found = F.schema_of_variant(F.col(f"body.{name}"))
        return F.when(found.rlike(kinds), F.try_variant_get(F.col(f"body.{name}"), "$", cast))

    numbers = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    return lines.withColumn("body", body).select(
        *[c for c in lines.columns if c != "value"],
        field("fileName", "^STRING$", "string").alias("fileName"),
        field("fileSize", numbers, "double").alias("fileSize"),
        field("mimeType", "^STRING$", "string").alias("mimeType"),
        (~an_object).alias("malformed"),
        F.col("value").alias("line"),
    )


def read_upload_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))
