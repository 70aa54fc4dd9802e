"""Runs a query in Spark and its SQL in DuckDB, and compares columns, row counts and values."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect(config={"memory_limit": "12GB", "max_temp_directory_size": "2GB"})
    for name in TABLES.split():
        if glob.glob(os.path.join(sf_dir, f"{name}.parquet")):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else ("number", round(value, 9))
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return ("number", round(float(value), 9))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), _bag(df.columns, [tuple(r) for r in df.collect()])


def oracle_bag(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _bag(columns, cursor.fetchall())


def difference(df, connection, sql: str) -> str | None:
    """What differs, or None."""
    columns, mine = spark_bag(df)
    expected_columns, expected = oracle_bag(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if mine != expected:
        extra, missing = list((mine - expected).items())[:3], list((expected - mine).items())[:3]
        return f"{sum(mine.values())} rows against {sum(expected.values())}; extra {extra}; missing {missing}"
    return None if mine else "no rows"
