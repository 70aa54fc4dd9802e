"""Reading and writing the three stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.uploads import current_status
from docquarry.schemas import TABLES


def _current(name: str, table: DataFrame) -> DataFrame:
    if name == "documents":
        return table.withColumn("status", current_status(F.col("status")))
    return table


def read_tables(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    """The stored tables under ``location``, one parquet folder each, with their declared schemas."""
    return {
        name: _current(name, spark.read.schema(schema).parquet(f"{location.rstrip('/')}/{name}"))
        for name, schema in TABLES.items()
    }


def read_database_tables(
    spark: SparkSession, url: str, bounds: Sequence[str], properties: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """The same tables over JDBC, read by tasks that each take a range of the primary key ``id``.

    ``bounds`` are the ids that part the ranges, in order; n of them make n + 1 tasks, which together
    take every id. Untested: it needs a database.
    """
    edges = [None, *bounds, None]
    ranges = [
        " AND ".join([*([f"id >= '{low}'"] if low else []), *([f"id < '{high}'"] if high else [])]) or "TRUE"
        for low, high in zip(edges, edges[1:])
    ]
    source_names = {"accounts": "User", "sessions": "RefreshToken", "documents": "Document"}
    tables = {}
    for name, schema in TABLES.items():
        rows = spark.read.jdbc(url, f'"{source_names[name]}"', predicates=ranges, properties={"preferTimestampNTZ": "true", **(properties or {})})
        tables[name] = _current(name, rows.select(schema.names))
    return tables


def append_documents(documents: DataFrame, path: str) -> None:
    """Adds catalog rows, partitioned by status.

    The rebalance hint gives few files per status, and splits a status that holds most of the rows
    over several tasks. Files are sorted by ``userId``, so a reader of one account skips most row groups.
    An append is not repeatable: pass rows through ``new_rows`` first.
    """
    columns = [F.col(n).cast(TABLES["documents"][n].dataType).alias(n) for n in TABLES["documents"].names]
    rows = documents.select(*columns).hint("rebalance", F.col("status")).sortWithinPartitions("status", "userId")
    rows.write.mode("append").partitionBy("status").parquet(path)


def bloom_options(keys: Mapping[str, int]) -> dict[str, str]:
    """Write options for a Bloom filter on each key column, for so many different values in a file."""
    options = {}
    for column, values in keys.items():
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(values)
    return options


def write_new_version(table: DataFrame, path: str, keys: Mapping[str, int] | None = None) -> None:
    """Writes a changed table beside the one it was read from; never over it.

    ``keys`` name columns that rows are looked up by, with how many values a file has: ids and tokens
    are spread over all files, so their least and greatest values rule none out, but a Bloom filter
    does, for a literal key and for the keys of a join that Spark turns into one.
    """
    table.write.mode("errorifexists").options(**bloom_options(keys or {})).parquet(path)


def find_by_key(table: DataFrame, key: str, *values: str) -> DataFrame:
    """The rows with one of a few literal keys; row groups whose filters rule them out are not read."""
    return table.where(F.col(key).isin(*values) if len(values) != 1 else F.col(key) == values[0])
